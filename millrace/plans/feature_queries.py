"""Queries over feature matrices and image volumes (embeddings) and numeric columns (lineitem).

Floating-point results are rounded to six decimals, in the SQL as well.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars as fn
from millrace.operators import forest, masks, matrix, relational, statistics, volumes
from millrace.plans.registry import Registry
from millrace.sources.tables import long_features, scan
from millrace.sources.volumes import scan_files, scan_volumes, to_millimetres, volume_geometry, write_volumes
from millrace.sources.workspace import fresh_path, inputs_digest, materialize, remembered

R = Registry()
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LONG = """WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value,
 CAST(unnest(range(len(embedding))) AS INTEGER) AS pos FROM embeddings) """


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return long_features(scan(spark, sf, "embeddings"), "vec_id", "embedding", "label")


def _dim(df: DataFrame) -> int:
    """The length that most vectors have, the shorter one if equally many."""
    return df.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first().dim


@R.add(_LONG + "SELECT vec_id, pos, round(value, 6) AS value, label FROM f")
def s1_feature_matrix(spark, sf):
    return _features(spark, sf).withColumn("value", F.round("value", 6))


@R.add(_LONG + "SELECT vec_id % 64 AS x, vec_id // 64 AS z, pos AS t, round(value, 6) AS value FROM f")
def s3_open_volume(spark, sf):
    """A file for each 64 voxels is written by the tasks into a folder, and the folder is opened."""
    folder = fresh_path(spark, "volumes")
    write_volumes(scan(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("z"), (F.col("vec_id") % 64).alias("x"), "embedding"), folder)
    opened = scan_volumes(spark, folder)
    z = F.regexp_extract("path", r"(\d+)\.nii$", 1).cast("long").alias("z")
    return opened.where(~F.isnan("value")).select(F.col("x").cast("long").alias("x"), z, "t", F.round("value", 6).alias("value"))


#: Voxels of 4 x 4 x 5 millimetres, turned by a right angle about z and shifted.
AFFINE = ((0.0, -4.0, 0.0, 90.0), (4.0, 0.0, 0.0, -126.0), (0.0, 0.0, 5.0, -72.0), (0.0, 0.0, 0.0, 1.0))


def _head_files(spark: SparkSession, sf: str) -> str:
    """A folder with a file for each 512 vectors, written by the tasks: 8 x 8 x 8 voxels, the vector over time, brighter by 6
    in a ball around the middle, which stands for a head, and in scattered specks."""
    v = F.col("vec_id")
    places = {"image": F.floor(v / 512), "x": v % 8, "y": F.floor(v / 8) % 8, "z": F.floor(v / 64) % 8}
    squares = [(F.col(p) - 3.5) * (F.col(p) - 3.5) for p in ("x", "y", "z")]
    bright = F.when((squares[0] + squares[1] + squares[2] <= 10) | (v % 89 == 0), 6.0).otherwise(0.0)
    rows = scan(spark, sf, "embeddings").select("vec_id", *[c.alias(n) for n, c in places.items()], "embedding").withColumn("bright", bright)
    rows = rows.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda e: e + F.col("bright")))
    folder = fresh_path(spark, "heads")
    write_volumes(rows, folder, key="image", affine=np.array(AFFINE), t_step=2.0)
    return folder


_HEAD = _LONG + """, hd AS (SELECT vec_id, vec_id // 512 AS image, vec_id % 8 AS x, (vec_id // 8) % 8 AS y, (vec_id // 64) % 8 AS z, pos AS t, value
  + CASE WHEN pow(vec_id % 8 - 3.5, 2) + pow((vec_id // 8) % 8 - 3.5, 2) + pow((vec_id // 64) % 8 - 3.5, 2) <= 10 OR vec_id % 89 = 0 THEN 6 ELSE 0 END AS value FROM f) """


def _image(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(\d+)\.nii$", 1).cast("long")


@R.add(_HEAD + "SELECT image, x, y, z, -4.0 * y + 90 AS x_mm, 4.0 * x - 126 AS y_mm, 5.0 * z - 72 AS z_mm, avg(value) > 3 AS bright FROM hd GROUP BY ALL")
def s3_voxel_places(spark, sf):
    """Where the voxels of files lie in millimetres, by the affine in the files' headers."""
    folder = _head_files(spark, sf)
    means = volumes.mean_image(scan_volumes(spark, folder), ["path"]).where(~F.isnan("mean_value"))
    placed = to_millimetres(means, volume_geometry(scan_files(spark, folder)))
    return placed.select(_image().alias("image"), *[F.col(p).cast("long").alias(p) for p in volumes.PLACE], "x_mm", "y_mm", "z_mm", (F.col("mean_value") > 3).alias("bright"))


@R.add(
    _HEAD
    + """SELECT DISTINCT vec_id // 512 AS image, [8, least(8, greatest(1, ceil(least(n, 64) / 8)))::INTEGER, least(8, ceil(n / 64))::INTEGER, 64] AS dims,
 [4.0, 4.0, 5.0] AS voxel, 2.0 AS t_step FROM (SELECT vec_id, count(*) OVER (PARTITION BY vec_id // 512) AS n FROM embeddings)"""
)
def s3_volume_geometry(spark, sf):
    """Size, voxel edges and time step of files, read from their headers alone."""
    known = volume_geometry(scan_files(spark, _head_files(spark, sf)))
    return known.select(_image().alias("image"), "dims", "voxel", "t_step")


def _describe_sql(c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, 0.{p}), 4) AS q{p}" for p in (25, 5, 75)).replace("q5,", "q50,").replace("AS q5 ", "AS q50 ")
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(min({c}), 4) AS "min", {q}, round(max({c}), 4) AS "max" FROM lineitem"""


@R.add(" UNION ALL ".join(map(_describe_sql, NUMBERS)))
def g1_describe(spark, sf):
    out = statistics.describe(scan(spark, sf, "lineitem"), NUMBERS)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


@R.add(_LONG + "SELECT pos, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM f GROUP BY pos")
def g2_scaler_fit(spark, sf):
    fitted = matrix.fit_scaler(scan(spark, sf, "embeddings"), "embedding")
    rows = [(i, m, s) for i, (m, s) in enumerate(zip(fitted.mean, fitted.std))]
    return spark.createDataFrame(rows, "pos int, mean double, std double").select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@R.add("SELECT round(sum(100 * l_tax), 2) AS total FROM lineitem")
def g3_total(spark, sf):
    return scan(spark, sf, "lineitem").agg(F.round(F.sum(fn.percent(F.col("l_tax"))), 2).alias("total"))


@R.add(
    _LONG
    + """SELECT label, pos, round(m, 6) AS m FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(m) DESC, pos) AS i
 FROM (SELECT label, pos, avg(value) AS m FROM f GROUP BY label, pos)) WHERE i = 1"""
)
def g4_largest_in_group(spark, sf):
    means = _features(spark, sf).groupBy("label", "pos").agg(F.avg("value").alias("m"))
    return relational.best_in_group(means, "label", F.abs("m"), "pos").withColumn("m", F.round("m", 6))


@R.add("SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def g5_shape(spark, sf):
    rows, columns = statistics.shape(scan(spark, sf, "lineitem"))
    return spark.createDataFrame([(rows, columns)], "n_rows long, n_columns int")


@R.add("SELECT round(avg(CASE WHEN l_linestatus = l_returnflag THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem")
def g6_accuracy(spark, sf):
    out = statistics.accuracy(scan(spark, sf, "lineitem"), "l_linestatus", "l_returnflag")
    return out.withColumn("accuracy", F.round("accuracy", 6))


_VOLUME = _LONG + """, vol AS (SELECT vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 AS z, pos AS t, value FROM f) """


def _volume(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    places = (v % 8).alias("x"), (F.floor(v / 8) % 8).alias("y"), F.floor(v / 64).alias("z")
    return _features(spark, sf).select(*places, F.col("pos").alias("t"), "value")


@R.add(_VOLUME + "SELECT x, y, z, round(avg(value), 6) AS mean_value FROM vol GROUP BY x, y, z")
def g7_mean_image(spark, sf):
    return volumes.mean_image(_volume(spark, sf)).withColumn("mean_value", F.round("mean_value", 6))


_ANOVA = _LONG + """, g AS (SELECT pos, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM f GROUP BY pos, label),
 t AS (SELECT pos, sum(n) AS n_all, count(*) AS k, sum(n * m) / sum(n) AS grand, sum(n * v) AS within FROM g GROUP BY pos),
 s AS (SELECT g.pos, (sum(n * (m - grand) * (m - grand)) / (any_value(k) - 1)) / (any_value(within) / (any_value(n_all) - any_value(k))) AS f_score
  FROM g JOIN t ON g.pos = t.pos GROUP BY g.pos) """


@R.add(_ANOVA + "SELECT pos, round(f_score, 6) AS f_score FROM s")
def g8_anova_f(spark, sf):
    return statistics.anova_f(_features(spark, sf)).withColumn("f_score", F.round("f_score", 6))


@R.add(_ANOVA + "SELECT pos, round(f_score, 6) AS f_score FROM s ORDER BY s.f_score DESC, pos LIMIT 3")
def t4_select_k_best(spark, sf):
    """The flagship: one-way ANOVA F of every feature, and the three best in their original order."""
    best = statistics.select_k_best(statistics.anova_f(_features(spark, sf)), 3)
    return best.withColumn("f_score", F.round("f_score", 6))


@R.add(_LONG + "SELECT vec_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM f GROUP BY vec_id")
def g10_across_components(spark, sf):
    stats = _features(spark, sf).groupBy("vec_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_SHARES = _LONG + """, p AS (SELECT pos, var_pop(value) AS v FROM f GROUP BY pos),
 o AS (SELECT pos, row_number() OVER (ORDER BY v DESC, pos) AS place, v / sum(v) OVER () * 100 AS pct FROM p),
 w AS (SELECT *, sum(pct) OVER (ORDER BY place) AS cum_pct FROM o) """


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    spread = _features(spark, sf).groupBy("pos").agg(F.var_pop("value").alias("v"))
    return statistics.running_share(spread, [F.desc("v"), F.col("pos")], "v")


@R.add(_SHARES + "SELECT CAST(place AS INTEGER) AS place, pos, round(pct, 6) AS pct, round(cum_pct, 6) AS cum_pct FROM w")
def w1_running_share(spark, sf):
    return _shares(spark, sf).select("place", "pos", F.round("pct", 6).alias("pct"), F.round("cum_pct", 6).alias("cum_pct"))


@R.add(_SHARES + "SELECT round(cum_pct, 6) AS cum_pct FROM w WHERE place = 10")
def w2_tenth_share(spark, sf):
    return _shares(spark, sf).where("place = 10").select(F.round("cum_pct", 6).alias("cum_pct"))


@R.add(_SHARES + "SELECT CAST(1 + count(*) AS INTEGER) AS k FROM w WHERE cum_pct <= 95")
def w3_parts_needed(spark, sf):
    return statistics.parts_needed(_shares(spark, sf), 95)


@R.add(
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in NUMBERS)
    + " FROM lineitem"
)
def a1_standardize(spark, sf):
    scaled = statistics.standard_scores(scan(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS), NUMBERS)
    return scaled.withColumns({c: F.round(c, 6) for c in NUMBERS})


@R.add(
    _LONG
    + """SELECT vec_id, pos, round((value - avg(value) OVER (PARTITION BY pos)) / stddev_pop(value) OVER (PARTITION BY pos), 6) AS value FROM f"""
)
def a1_standardize_vectors(spark, sf):
    vectors = scan(spark, sf, "embeddings")
    scaled = matrix.fit_scaler(vectors, "embedding").transform(vectors, "embedding")
    return long_features(scaled, "vec_id", "embedding").withColumn("value", F.round("value", 6))


def _components(spark: SparkSession, sf: str) -> tuple[DataFrame, matrix.Components]:
    vectors = scan(spark, sf, "embeddings")
    scaled = matrix.fit_scaler(vectors, "embedding").transform(vectors, "embedding")
    return scaled, matrix.fit_components(scaled, "embedding", _dim(vectors))


@R.add()
def a2_explained_variance(spark, sf):
    ratio = _components(spark, sf)[1].variance(spark).withColumn("pct", fn.percent(F.col("ratio")))
    return statistics.running_share(ratio, [F.col("component")], "ratio").select("component", F.round("pct", 6).alias("pct"), F.round("cum_pct", 6).alias("cum_pct"))


@R.add()
def a3_components(spark, sf):
    """As many components as explain more than 95 % of the variance."""
    scaled, fitted = _components(spark, sf)
    scored = fitted.transform(scaled, "embedding", fitted.needed(0.95))
    return scored.select("vec_id", F.transform("components", lambda x: F.round(x, 6)).alias("components"))


@R.add()
def a4_loadings(spark, sf):
    rows = _components(spark, sf)[1].loading_rows(spark)
    return relational.best_in_group(rows, "component", F.abs("loading"), "pos").withColumn("loading", F.round("loading", 6))


_SPLIT = """SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM embeddings"""


@R.add(_SPLIT)
def a5_exact_split(spark, sf):
    return statistics.exact_split(scan(spark, sf, "embeddings"), "vec_id", 0.2).select("vec_id", "is_test")


#: Forests of the session, by application and what the vectors' files are; they are models, not tables, and each is fitted once.
_fitted: dict[tuple, tuple] = {}


def _once(name: str, spark: SparkSession, sf: str, fit: Callable[[], tuple]) -> tuple:
    key = name, spark.sparkContext.applicationId, sf, inputs_digest(spark, [f"{sf}/embeddings.parquet"])
    if key not in _fitted:
        _fitted[key] = fit()
    return _fitted[key]


def _forest(spark: SparkSession, sf: str) -> tuple:
    """The stored split, and the forest on all features: 100 trees of the greatest depth that Spark has."""

    def fit() -> tuple:
        made = lambda: statistics.exact_split(scan(spark, sf, "embeddings"), "vec_id", 0.2)
        split = remembered(spark, "forest-split", [f"{sf}/embeddings.parquet"], {"fraction": 0.2, "seed": ""}, made)
        return split, forest.fit_forest(forest.with_features(split.where("not is_test"), "embedding"), trees=100, depth=30)

    return _once("all", spark, sf, fit)


def _small_forest(spark: SparkSession, sf: str) -> tuple:
    """The ten most important features, and the forest on them alone."""

    def fit() -> tuple:
        split, model = _forest(spark, sf)
        top = [r.pos for r in relational.top_k(forest.importance(model, split), "importance", "pos", 10).collect()]
        return top, forest.fit_forest(forest.with_features(split.where("not is_test"), "embedding", top), trees=100, depth=30)

    return _once("top", spark, sf, fit)


def _refit_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    top, small = _small_forest(spark, sf)
    return statistics.accuracy(small.transform(forest.with_features(_forest(spark, sf)[0].where("is_test"), "embedding", top)))


@R.add()
def a6_forest_accuracy(spark, sf):
    split, model = _forest(spark, sf)
    every = statistics.accuracy(model.transform(forest.with_features(split.where("is_test"), "embedding"))).withColumn("features", F.lit("all"))
    return every.unionByName(_refit_accuracy(spark, sf).withColumn("features", F.lit("top 10")))


@R.add()
def a7_refit_accuracy(spark, sf):
    """The forest of the ten most important features alone."""
    return _refit_accuracy(spark, sf)


@R.add()
def g9_importance(spark, sf):
    split, model = _forest(spark, sf)
    return forest.importance(model, split).withColumn("importance", F.round("importance", 6))


def _mask(volume: DataFrame) -> DataFrame:
    """The voxels whose mean over time is above 0."""
    return volumes.mean_image(volume).where("mean_value > 0").select(*volumes.PLACE)


_MASK = "SELECT x, y, z FROM vol GROUP BY x, y, z HAVING avg(value) > 0"

@R.add(
    _VOLUME
    + f""", w1 AS (SELECT d, exp(-d * d / (2 * pow(8 / 4 / sqrt(8 * ln(2)), 2))) AS w FROM (SELECT unnest(range(-3, 4)) AS d)),
 ax AS (SELECT d, w / sum(w) OVER () AS w FROM w1),
 sm AS (SELECT v.x + a.d AS x, v.y + b.d AS y, v.z + c.d AS z, t, sum(value * a.w * b.w * c.w) AS value FROM vol v, ax a, ax b, ax c GROUP BY ALL),
 mk AS (SELECT sm.* FROM sm JOIN ({_MASK}) USING (x, y, z))
 SELECT x, y, z, t, round((value - avg(value) OVER p) / stddev_pop(value) OVER p, 5) AS value FROM mk WINDOW p AS (PARTITION BY x, y, z)"""
)
def a8_mask_transform(spark, sf):
    volume = _volume(spark, sf)
    return volumes.mask_transform(volume, _mask(volume), fwhm=8, voxel=4).withColumn("value", F.round("value", 5))


def _near(a: str, b: str) -> str:
    return f"{a}.image = {b}.image AND abs({a}.x - {b}.x) + abs({a}.y - {b}.y) + abs({a}.z - {b}.z) <= 1"


_EPI = (
    _HEAD.replace("WITH f", "WITH RECURSIVE f")
    + f""", mn AS (SELECT image, x, y, z, avg(value) AS m FROM hd GROUP BY ALL),
 rk AS (SELECT image, m, row_number() OVER w - 1 AS i, lead(m) OVER w AS up, count(*) OVER (PARTITION BY image) AS n FROM mn WINDOW w AS (PARTITION BY image ORDER BY m)),
 th AS (SELECT image, arg_max((m + up) / 2, up - m) AS cut FROM rk WHERE i >= floor(0.2 * n) AND i < least(floor(0.85 * n), n - 1) GROUP BY image),
 mk AS (SELECT mn.image, x, y, z FROM mn JOIN th ON mn.image = th.image WHERE m >= cut),
 er AS (SELECT a.* FROM mk a JOIN mk b ON {_near("a", "b")} GROUP BY ALL HAVING count(*) = 7),
 rc AS (SELECT image, x, y, z, x + 8 * (y + 8 * z) AS id FROM er UNION SELECT b.image, b.x, b.y, b.z, rc.id FROM rc JOIN er b ON {_near("rc", "b")}),
 cp AS (SELECT image, x, y, z, min(id) AS id FROM rc GROUP BY ALL),
 bg AS (SELECT image, arg_max(id, n * 10000 - id) AS id FROM (SELECT image, id, count(*) AS n FROM cp GROUP BY ALL) GROUP BY image),
 k0 AS (SELECT cp.image, x, y, z FROM cp JOIN bg ON cp.image = bg.image AND cp.id = bg.id),
 k1 AS (SELECT DISTINCT a.image, a.x, a.y, a.z FROM mn a JOIN k0 b ON {_near("a", "b")}),
 k2 AS (SELECT DISTINCT a.image, a.x, a.y, a.z FROM mn a JOIN k1 b ON {_near("a", "b")}),
 em AS (SELECT a.* FROM k2 a JOIN k2 b ON {_near("a", "b")} GROUP BY ALL HAVING count(*) = 7) """
)


def _head(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From files: the volumes (image, x, y, z, t, value, voxel), their mean images and the masks of the heads."""
    folder = _head_files(spark, sf)
    edges = volume_geometry(scan_files(spark, folder)).select(_image().alias("image"), "voxel")
    rows = scan_volumes(spark, folder).where(~F.isnan("value")).withColumn("image", _image())
    kinds = [F.col(p).cast("long").alias(p) for p in volumes.PLACE]
    volume = materialize(rows.select("image", *kinds, "t", "value"), "head-volume")
    means = materialize(volumes.mean_image(volume, ["image"]), "head-means")
    return volume.join(edges, "image"), means, masks.epi_mask(means, ["image"], opening=1)


@R.add(_HEAD + """, mn AS (SELECT image, x, y, z, avg(value) AS m FROM hd GROUP BY ALL),
 rk AS (SELECT image, m, row_number() OVER w - 1 AS i, lead(m) OVER w AS up, count(*) OVER (PARTITION BY image) AS n FROM mn WINDOW w AS (PARTITION BY image ORDER BY m))
 SELECT image, round(arg_max((m + up) / 2, up - m), 6) AS threshold FROM rk WHERE i >= floor(0.2 * n) AND i < least(floor(0.85 * n), n - 1) GROUP BY image""")
def a8_gap_threshold(spark, sf):
    return masks.gap_threshold(_head(spark, sf)[1], ["image"]).withColumn("threshold", F.round("threshold", 6))


@R.add(_EPI + "SELECT image, x, y, z FROM em")
def a8_epi_mask(spark, sf):
    """The head in each image: the widest gap, opening, and the largest component; from files."""
    return _head(spark, sf)[2]


@R.add(_EPI + "SELECT image, x, y, z FROM em")
def a8_stored_mask(spark, sf):
    """The mask as a stored step: made once for these vectors and parameters, read from then on, in later sessions as well."""
    parameters = {"opening": 1, "connected": True, "affine": AFFINE}
    return remembered(spark, "epi-mask", [f"{sf}/embeddings.parquet"], parameters, lambda: _head(spark, sf)[2])


@R.add(
    _EPI
    + """, w1 AS (SELECT e, d, exp(-d * d / (2 * pow(8 / e / sqrt(8 * ln(2)), 2))) AS w FROM (SELECT unnest(range(-3, 4)) AS d), (VALUES (4), (5)) AS edge(e)),
 w2 AS (SELECT * FROM w1 WHERE abs(d) <= floor(4 * (8 / e / sqrt(8 * ln(2))) + 0.5)),
 ax AS (SELECT e, d, w / sum(w) OVER (PARTITION BY e) AS w FROM w2),
 sm AS (SELECT v.image, v.x + a.d AS x, v.y + b.d AS y, v.z + c.d AS z, t, sum(value * a.w * b.w * c.w) AS value
  FROM hd v, ax a, ax b, ax c WHERE a.e = 4 AND b.e = 4 AND c.e = 5 GROUP BY ALL),
 ms AS (SELECT sm.* FROM sm JOIN em ON sm.image = em.image AND sm.x = em.x AND sm.y = em.y AND sm.z = em.z)
 SELECT image, x, y, z, t, round((value - avg(value) OVER p) / stddev_pop(value) OVER p, 5) AS value FROM ms WINDOW p AS (PARTITION BY image, x, y, z)"""
)
def a8_epi_series(spark, sf):
    """The matrix that components are fitted on, in long form: each axis smoothed by its own voxel edge."""
    volume, _, mask = _head(spark, sf)
    series = volumes.mask_series(volume, mask, fwhm=8, voxel="voxel", keys=["image"])
    return volumes.from_series(series, ["image"]).withColumn("value", F.round("value", 5))


@R.add()
def a9_independent_components(spark, sf):
    """From files to thresholded component volumes: ten components of the masked, smoothed and standardized series of the
    heads, normalised across components, cut at 0.8 deviations and put back where the voxels were, 0 elsewhere."""
    volume, means, mask = _head(spark, sf)
    steps = int(volume.agg(F.max("t")).first()[0]) + 1
    series = materialize(volumes.filled(volumes.mask_series(volume, mask, fwhm=8, voxel="voxel", keys=["image"], steps=steps)), "head-series")
    found = matrix.fast_ica(series, volumes.SERIES, steps, 10)
    sources = found.transform(series, volumes.SERIES).drop(volumes.SERIES).withColumnRenamed("sources", volumes.SERIES)
    cut = F.transform(volumes.SERIES, lambda x: matrix.hard_threshold(x))
    scaled = volumes.standardize_series(sources).withColumn(volumes.SERIES, cut)
    return volumes.inverse_series(scaled, means, ["image"]).withColumn("value", F.round("value", 6)).withColumn("converged", F.lit(found.converged))


@R.add()
def a9_vector_components(spark, sf):
    """Ten components of the vectors as they stand, normalised across components, cut at 0.8 deviations."""
    vectors = scan(spark, sf, "embeddings")
    found = matrix.fast_ica(vectors, "embedding", _dim(vectors), 10)
    rows = long_features(found.transform(vectors, "embedding"), "vec_id", "sources")
    scaled = statistics.standardize_group(rows, ["vec_id"], "value")
    return scaled.select("vec_id", F.col("pos").alias("component"), F.round(matrix.hard_threshold(F.col("value")), 6).alias("value"), F.lit(found.converged).alias("converged"))


_CUT = _VOLUME + """, n AS (SELECT x, y, z, t, (value - avg(value) OVER p) / stddev_pop(value) OVER p AS s FROM vol WINDOW p AS (PARTITION BY x, y, z)),
 c AS (SELECT x, y, z, t AS component, CASE WHEN abs(s) < 0.8 THEN 0.0 ELSE s END AS value FROM n) """


def _cut(spark: SparkSession, sf: str) -> DataFrame:
    scaled = statistics.standardize_group(_volume(spark, sf), volumes.PLACE, "value").withColumnRenamed("t", "component")
    return scaled.withColumn("value", matrix.hard_threshold(F.col("value")))


@R.add(_CUT + "SELECT x, y, z, component, round(value, 6) AS value FROM c")
def a10_hard_threshold(spark, sf):
    return _cut(spark, sf).select("x", "y", "z", "component", F.round("value", 6).alias("value"))


@R.add(
    _CUT
    + f"""SELECT c.x, c.y, c.z, component, round(CASE WHEN m.x IS NOT NULL THEN value ELSE 0.0 END, 6) AS value
 FROM c LEFT JOIN ({_MASK}) m ON c.x = m.x AND c.y = m.y AND c.z = m.z"""
)
def a11_inverse_mask(spark, sf):
    space = _cut(spark, sf)
    inside = volumes.masked(space, _mask(_volume(spark, sf)))
    return volumes.inverse_mask(inside, space).withColumn("value", F.round("value", 6))


@R.add(_CUT + "SELECT x, y, z, round(value, 6) AS value FROM c WHERE component = 1")
def a12_component_image(spark, sf):
    return volumes.component_image(_cut(spark, sf), 1).select("x", "y", "z", F.round("value", 6).alias("value"))
