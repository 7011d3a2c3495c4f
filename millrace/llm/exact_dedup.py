"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_ROWS, free_name, join_sized, materialize, sized_broadcast

#: Characters whose hash is the second step's key.
PREFIX_CHARS = 256


def shared_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(len): the lengths in bytes that occur again; the first step."""
    sizes = docs.select(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("len")).groupBy("len").agg(F.count("*").alias("n"))
    return materialize(sizes.where("n > 1").select("len"), "dedup-lengths")


def shared_prefixes(marked: DataFrame, length: str, prefix: str) -> DataFrame:
    """The pairs of length and prefix hash that occur again; the second step. Rows without a prefix hash are passed over."""
    sizes = marked.where(F.col(prefix).isNotNull()).groupBy(length, prefix).agg(F.count("*").alias("n"))
    return materialize(sizes.where("n > 1").select(length, prefix), "dedup-prefixes")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Adds ``keep_id``, ``group_size`` and ``kept`` to every row; of equal texts the row with the largest id stays.

    The first scan reads lengths. The second hashes the prefixes of texts whose length occurs again, and the third
    makes SHA-256 of the texts whose length and prefix occur again; all other rows pass as they are. Keys are broadcast
    while they fit ``broadcast_rows``; beyond it rows are joined by key. The hash, not the text, decides the group.

    Cases: a null text equals the empty one. Null ids sort below all others. Rows that repeat both id and text are
    copies of each other: exactly one of them stays; such rows alone are numbered, and the lowest number of an id and
    text is combined before the exchange, so however many there are no task gathers them. An empty table gives an empty result. Columns of these names that the input has already are replaced;
    all its other columns are carried along.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    length, prefix, full, copy, again = (free_name(docs, n) for n in ("len", "prefix", "full", "copy_no", "len_again"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lengths = sized_broadcast(shared_lengths(docs, text_col).select(F.col("len").alias(length), F.lit(True).alias(again)), broadcast_rows)
    marked = docs.withColumn(length, F.octet_length(text)).join(lengths, length, "left")
    marked = marked.withColumn(prefix, F.when(F.col(again), F.xxhash64(F.substring(text, 1, prefix_chars)))).drop(again)
    keys = sized_broadcast(shared_prefixes(marked, length, prefix), broadcast_rows)

    first = marked.join(keys, [length, prefix], "left_anti").drop(length, prefix)
    rivals = marked.join(keys, [length, prefix], "left_semi").withColumn(full, F.sha2(text, 256)).drop(length, prefix)
    rows = materialize(rivals.groupBy(full, F.col(id_col).alias("id")).agg(F.count("*").alias("n")), "dedup-rows")
    groups = rows.groupBy(full).agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = materialize(groups.withColumn("n", F.col("group_size")), "dedup-groups")
    small = groups.limit(broadcast_rows + 1).count() <= broadcast_rows
    met = rivals.join(F.broadcast(groups.drop("n")), full) if small else join_sized(rivals, groups, full, deal=F.xxhash64(id_col))

    again = rows.where("n > 1")
    if again.isEmpty():
        decided = met.withColumn(copy, F.lit(True))
    else:
        other, row, number = (free_name(docs, n) for n in ("row_full", "row_id", "row_no"))
        twice = sized_broadcast(again.select(F.col(full).alias(other), F.col("id").alias(row)), broadcast_rows)
        same = (F.col(full) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(row))
        # Numbers are written before they are compared, so that a task that runs again gives the same ones.
        numbered = materialize(met.join(twice, same, "left_semi").withColumn(number, F.monotonically_increasing_id()), "dedup-copies")
        lowest = numbered.groupBy(full, id_col).agg(F.min(number).alias(number)).select(number, F.lit(True).alias(copy))
        decided = numbered.join(lowest, number, "left").withColumn(copy, F.coalesce(F.col(copy), F.lit(False))).drop(number)
        decided = met.join(twice, same, "left_anti").withColumn(copy, F.lit(True)).unionByName(decided)
    decided = decided.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & F.col(copy))
    out = [*docs.columns, "keep_id", "group_size", "kept"]
    alone = first.withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return alone.select(out).unionByName(decided.select(out))
