"""Token counts behind a cache of content digests."""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import Chunks
from millrace.llm.shared import BROADCAST_ROWS, bound_batches, fresh_path, join_sized, lean_worker, materialize

#: Distinct chunks whose counts a worker remembers, about 150 bytes each.
MEMO = 400_000
CACHE_SCHEMA = "digest binary, n_tokens long, version string"


class Counter:
    """Counts the tokens of texts as the library of a vocabulary file does: tokenizers for .json, sentencepiece for .model.

    Special strings inside texts are handled as the library's default. A byte-level tokenizer without normalizer and
    post-processor cuts at every space between two non-space characters, so its chunks are counted once each.
    """

    def __init__(self, data: bytes, kind: str) -> None:
        self.by_chunk = False
        self.chunks = Chunks(lambda new: self.known.extend(self.count(new)), self._keep, MEMO)
        self.known = array("q")
        if kind == ".model":
            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        elif kind == ".json":
            spec, coder = json.loads(data), tokenizers.Tokenizer.from_str(data.decode())
            coder.no_truncation()
            coder.no_padding()
            pre = spec.get("pre_tokenizer") or {}
            plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
            spaced = any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
            level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            self.by_chunk = bool(level and plain and not spaced and not spec.get("normalizer") and not spec.get("post_processor"))
            self.count = lambda texts: [len(x.ids) for x in coder.encode_batch(texts, add_special_tokens=False)]
        else:
            raise ValueError(f"no library for {kind} files")

    def _keep(self, rows: np.ndarray) -> None:
        self.known = array("q", np.frombuffer(self.known, dtype=np.int64)[rows].tobytes())

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not self.by_chunk:
            return np.array(self.count(texts), dtype=np.int64)
        rows, begin = self.chunks.rows(texts)
        upto = np.r_[0, np.cumsum(np.frombuffer(self.known, dtype=np.int64)[rows])]
        return np.diff(upto[begin])


@lru_cache(maxsize=2)
def _counter(data: bytes, kind: str) -> Counter:
    lean_worker()
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its own
    return Counter(data, kind)


def _encode(data: bytes, kind: str, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(data, kind)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                counts = counter(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = 256,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row a document: (``id_col``, digest, n_bytes, n_tokens).

    Normalised content is the text with null as empty, in UTF-8; its SHA-256 and a digest of the tokenizer file and
    library version are the key of the cache. The first scan makes digests only. Digests without a stored count are
    misses; one row of each is encoded, in the second scan, and the counts are appended to ``cache_path`` (parquet;
    in the shared folder and used by this call alone where it is not given). All counts then come from the cache.

    Rows to encode, or else rows to pass over, are broadcast if their counted rows are few; otherwise they are joined
    by id and digest. Cases: repeated rows and rows with null ids have a count each; an empty table gives an empty
    result; other columns are ignored. A null cache file column or another version never matches.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer, "rb") as f:
        data = f.read()
    kind = os.path.splitext(tokenizer)[1]
    library = tokenizers.__version__ if kind == ".json" else sentencepiece.__version__
    version = hashlib.sha256(data + f"{kind} {library}".encode()).hexdigest()
    cache_path = cache_path or fresh_path(spark, "token-counts")

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows_in = materialize(keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    first = materialize(rows_in.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n")), "token-distinct")
    misses = materialize(first.join(_cached(spark, cache_path, version), "digest", "left_anti"), "token-misses")

    same = ["digest", "id"]
    wanted = misses.select(F.col("digest").alias("m_digest"), F.col("id").alias("m_id"))
    matches = (F.col("digest") == F.col("m_digest")) & F.col("id").eqNullSafe(F.col("m_id"))
    rest = rows_in.select(same).join(wanted, matches, "left_anti").select(F.col("digest").alias("m_digest"), F.col("id").alias("m_id"))
    if misses.limit(broadcast_rows + 1).count() <= broadcast_rows // 8:
        to_encode = keyed.join(F.broadcast(wanted), matches, "left_semi")
    else:
        rest = materialize(rest, "token-known")
        if rest.limit(broadcast_rows + 1).count() <= broadcast_rows:
            to_encode = keyed.join(F.broadcast(rest), matches, "left_anti")
        else:
            to_encode = keyed.join(wanted, matches, "left_semi")
    encoded = to_encode.select("digest", "text").mapInArrow(_encode(data, kind, rows), "digest binary, n_tokens long")
    encoded.withColumn("version", F.lit(version)).write.mode("append").parquet(cache_path)
    counts = materialize(_cached(spark, cache_path, version).join(first.select("digest", "n"), "digest"), "token-known-counts")
    return join_sized(rows_in, counts, "digest").select(F.col("id").alias(id_col), "digest", "n_bytes", "n_tokens")
