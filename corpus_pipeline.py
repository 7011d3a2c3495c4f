"""Corpus pipeline: five stages over ``documents``, each a function (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of their input. Language ID drops the documents it rejects, those without
any letter; exact dedup keeps the row with the largest id of equal texts; SimHash near-dedup keeps the smallest id of
each component; mixing repeats or leaves out documents until each source has its target of words; byte-level BPE
encodes what is left and decodes it again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, exact_dedup, lang_id, mixing, simhash
from millrace.llm.shared import free_name, settled


def _beside(docs: DataFrame, added: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stage whose operator adds columns; columns of the input with such names step aside meanwhile."""
    aside, names = {}, docs
    for c in docs.columns:
        if c.lower() in added:
            aside[c] = free_name(names, f"kept_{c}")
            names = names.withColumnRenamed(c, aside[c])
    return stage(names).drop(*added).withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a language: null texts and texts without a letter; all if nothing is learned.

    All stages: rows with null ids and sources take part, repeated rows pass alike, texts are read whole, an empty table gives an empty
    one, and columns of whatever names come out as they went in.
    """
    return _beside(docs, ("lang_pred", "score"), lambda d: lang_id.learn_and_identify(d).where(F.col("lang_pred") != lang_id.UNKNOWN))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (null is empty) the row with the largest id, nulls below all others, and one of equal rows."""
    return _beside(docs, ("keep_id", "group_size", "kept"), lambda d: exact_dedup.exact_dedup(d).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of near copies the row with the smallest id, nulls after all others, and one of equal rows."""
    return simhash.keep_one(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is two rows, one that it leaves is none. Null is a source of its own."""

    def mix(d: DataFrame) -> DataFrame:
        mixed = mixing.mix_sources(d).where("copies > 0")
        return mixed.withColumn(free_name(mixed, "pass_no"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    return _beside(docs, ("size", "source_size", "target", "copies", "taken"), mix)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: a row of token count and digests for each row; null counts as empty, other columns go."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_to_targets),
    ("byte_bpe", encode),
]

#: SQL cannot express n-gram profiles, SimHash components or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each reads what the one before has written in the shared folder.

    A stage's own tables are deleted when its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, f"pipeline-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
