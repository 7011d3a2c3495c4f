"""Column statistics and feature scores over tables of any length."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.keyed import free_name

#: Buckets of a histogram; rows that an exact split ranks at a time, if their ids differ.
BUCKETS, RANKED = 4096, 10_000
QUARTILES = (0.25, 0.5, 0.75)


def exact_quantiles(df: DataFrame, bounds: Mapping[str, tuple[int, float, float]], shares: Sequence[float]) -> dict[tuple[str, float], float]:
    """Quantiles that interpolate between neighbours, as (column, share) -> value. bounds: count, least and largest of a column.

    The ranks wanted are found in histograms: each pass counts the rows of the ranges that still hold one, in
    BUCKETS buckets each, and goes on with the bucket's own least and largest value. A range shrinks at least by that
    factor, so a few passes suffice however many values differ, and no more than BUCKETS rows a range reach the driver.
    """
    wanted, at = {}, {}
    for c, (n, low, high) in bounds.items():
        for share in shares:
            place = share * (n - 1)
            wanted[c, share] = math.floor(place), math.ceil(place), place - math.floor(place)
            for rank in wanted[c, share][:2]:
                at[c, rank] = (low, high, 0)
    while ranges := sorted({(c, *span) for (c, _), span in at.items() if span[0] < span[1]}):
        one = []
        for no, (c, low, high, _) in enumerate(ranges):
            v = F.col(c).cast("double")
            step = F.least(F.floor((v - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
            one.append(F.when(v.between(low, high), F.struct(F.lit(no).alias("no"), step.alias("b"), v.alias("v"))))
        rows = df.select(F.explode(F.array_compact(F.array(*one))).alias("x")).select("x.*")
        counted = rows.groupBy("no", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        found: dict[int, list] = {}
        for r in counted.orderBy("no", "b").collect():
            found.setdefault(r.no, []).append(r)
        for (c, rank), span in at.items():
            if span[0] < span[1]:
                below = span[2]
                for r in found[ranges.index((c, *span))]:
                    if rank < below + r.n:
                        break
                    below += r.n
                ends = {below: r.low, below + r.n - 1: r.high}
                at[c, rank] = (ends[rank], ends[rank], below) if rank in ends else (r.low, r.high, below)
    value = lambda c, rank: at[c, rank][0]
    return {(c, s): value(c, a) + (value(c, b) - value(c, a)) * part for (c, s), (a, b, part) in wanted.items()}


def describe(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """One row a column: count, mean, sample deviation, least, quartiles and largest.

    One pass aggregates all columns; exact quartiles need a few more (``exact_quantiles``), ``exact=False`` has
    approximate ones in the same pass. Nulls and NaN do not count; columns without a value have nulls. An infinite value
    is an error, since there is no quartile between it and its neighbour.
    """
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    rough = lambda c: [] if exact else [F.percentile_approx(c, list(QUARTILES), 100_000).alias("q")]
    one = df.agg(*[F.struct(*[f(F.col(c).cast("double")).alias(n) for n, f in stats.items()], *rough(c)).alias(c) for c in columns]).first()
    bounds = {c: (one[c]["count"], one[c]["min"], one[c]["max"]) for c in columns if one[c]["count"]}
    if infinite := [c for c, (_, low, high) in bounds.items() if math.isinf(low) or math.isinf(high)]:
        raise ValueError(f"infinite values in {infinite}")
    found = exact_quantiles(df.select(*bounds), bounds, QUARTILES) if exact and bounds else {}
    rows = []
    for c in columns:
        q = [found.get((c, s)) for s in QUARTILES] if exact else [float(x) for x in one[c]["q"]] if one[c]["q"] else [None] * 3
        rows.append((c, one[c]["count"], one[c]["mean"], one[c]["std"], one[c]["min"], *q, one[c]["max"]))
    kinds = "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    return df.sparkSession.createDataFrame(rows, kinds)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def accuracy(predicted: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return predicted.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def anova_f(features: DataFrame, pos: str = "pos", value: str = "value", label: str = "label") -> DataFrame:
    """One-way ANOVA F of every feature of a long table: (pos, f_score).

    One shuffle of partial sums by (pos, label), then one small aggregation by pos; rows with a null value or label
    are left out. F is null where the groups do not vary or there is one group only.
    """
    known = features.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    groups = known.groupBy(pos, label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    sums = groups.groupBy(pos).agg(
        F.sum("n").alias("n_all"),
        F.count("*").alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("groups"),  # one entry a label
    )
    square = lambda g, grand: g["n"] * (g["m"] - grand) * (g["m"] - grand)
    between = F.aggregate("groups", F.lit(0.0), lambda acc, g: acc + square(g, F.col("grand")))
    score = F.try_divide(F.try_divide(between, F.col("k") - 1), F.nullif(F.try_divide(F.col("within"), F.col("n_all") - F.col("k")), F.lit(0.0)))
    return sums.select(pos, score.alias("f_score"))


def select_k_best(scores: DataFrame, k: int, score: str = "f_score", pos: str = "pos") -> DataFrame:
    """The k features of the largest scores, in their original order; ties go to the earlier feature."""
    return scores.orderBy(F.desc_nulls_last(score), pos).limit(k).orderBy(pos)


def running_share(parts: DataFrame, order: Sequence[Column], value: str) -> DataFrame:
    """Adds ``place``, ``pct`` of the total and the running sum ``cum_pct``. For tables of a row a feature or component."""
    by = Window.orderBy(*order)
    pct = F.col(value) / F.sum(value).over(Window.partitionBy()) * 100
    placed = parts.withColumns({"place": F.row_number().over(by), "pct": pct})
    return placed.withColumn("cum_pct", F.sum("pct").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))


def parts_needed(shares: DataFrame, above_pct: float) -> DataFrame:
    """The least number of leading parts whose running share is above a percentage."""
    return shares.agg((F.sum((F.col("cum_pct") <= above_pct).cast("int")) + 1).cast("int").alias("k"))


def exact_split(df: DataFrame, row_id: str, fraction: float, seed: str = "") -> DataFrame:
    """Adds ``is_test``: exactly ceil(fraction * n) rows, those of the smallest md5 of the id.

    Histograms over three hexadecimal digits at a time find the bucket where the count is reached, until it holds RANKED rows
    at most; only these are ranked. Rows that share an id go by a hash of the row, and rows without one by that hash
    alone, so reruns agree. Rows that are alike in all columns are told apart by nothing; if very many are, they are
    ranked in one task.
    """
    whole = F.xxhash64(*[F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)])
    digest = F.md5(F.concat(F.coalesce(F.col(row_id).cast("string"), F.concat(F.lit("row "), whole.cast("string"))), F.lit(seed)))
    d, h = free_name(df, "digest"), free_name(df, "whole")
    keyed = df.withColumns({d: digest, h: whole})
    want, edge, size = 0, "", 0
    for digits in range(3, 33, 3):
        sizes = keyed.where(F.col(d).startswith(edge)).groupBy(F.substring(d, 1, digits).alias("b")).count().collect()
        if not edge:
            want = math.ceil(fraction * sum(r["count"] for r in sizes) - 1e-9)
        for edge, size in sorted((r["b"], r["count"]) for r in sizes):
            if want <= size:
                break
            want -= size
        if size <= RANKED:
            break
    start = F.substring(d, 1, len(edge))
    inside = keyed.where(start == edge).withColumn("is_test", F.row_number().over(Window.orderBy(d, h)) <= want)
    rest = keyed.where(start != edge).withColumn("is_test", start < edge)
    return rest.unionByName(inside).drop(d, h)


def standard_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation of each column; a column that does not vary becomes 0.

    The statistics are one row, two numbers a column, and go into the plan as literals; rows are not shuffled.
    """
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def standardize_group(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Replaces a long table's values by (x - mean) / population deviation within each group; no variation gives 0."""
    own = Window.partitionBy(*group)
    spread = F.coalesce(F.nullif(F.stddev_pop(value).over(own), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(value, (F.col(value) - F.avg(value).over(own)) / spread)
