import calendar
import datetime
import gzip
import inspect
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from millrace.functions import scalars as fn
from millrace.operators import forest, matrix, relational, statistics, trees, volumes
from millrace.plans import feature_queries, relational_queries
from millrace.sources import uploads
from millrace.sources import volumes as source
from millrace.sources.tables import json_rows, scan


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return scan(spark, sf, "embeddings")


@pytest.fixture(scope="module")
def values(vectors):
    return np.array([r[0] for r in vectors.orderBy("vec_id").select("embedding").collect()], dtype=float)


def test_lookup_raises_on_none_and_several(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert relational.lookup(df, k=1).v == "a"
    for key in (2, 3, None):
        with pytest.raises(relational.LookupFailed):
            relational.lookup(df, k=key)
    with pytest.raises(ValueError):
        relational.without(df, "absent")


def test_uniqueness_with_nulls_and_repeats(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, None), (6, "c")], "i long, k string")
    old = spark.createDataFrame([("c",), ("c",), (None,)], "k string")
    got = {r.i: r.unique for r in relational.uniqueness(new, old, "k").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_update_takes_nulls_and_leaves_others(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, v string, w int")
    changes = spark.createDataFrame([(2, None), (9, "x")], "k long, v string")
    assert sorted(map(tuple, relational.update_by_key(df, changes, "k").collect())) == [(1, "a", 5), (2, None, 6)]


def test_validate_null_fails_and_messages(spark):
    df = spark.createDataFrame([("en", "a@b.cd", "x"), ("fr", "bad", "long one"), (None, None, None)], "lang string, email string, zip string")
    checks = relational.profile_checks(F.col("lang"), {"zip": (F.col("zip"), 4)}, F.col("email"))
    valid, rejected = relational.split_valid(relational.validate(df, checks))
    assert valid.count() == 1
    assert sorted(len(r.errors) for r in rejected.collect()) == [2, 3]


def test_age_in_words(spark):
    """From the first of a leap year: its own leap day is not taken off, so 731 days are two years and a day, not a month more."""
    cases = {0: "0 minutes", 59: "0 minutes", 60: "1 minute", 3600 * 26: "1 day, 2 hours", 86400 * 8: "1 week, 1 day", 31536000 * 2: "2 years", -5: "0 minutes", 86400 + 60: "1 day"}
    rows = [(s, f"2024-01-0{1}") for s in cases]
    df = spark.createDataFrame(rows, "s long, d string").withColumn("since", F.col("d").cast("timestamp"))
    as_of = F.timestamp_seconds(F.unix_timestamp("since") + F.col("s"))
    got = {r.s: r.age.replace(fn.SPACE, " ") for r in df.select("s", fn.age_in_words(F.col("since"), as_of).alias("age")).collect()}
    assert got == cases


def told_age(since, now):
    """The pinned library's rule (4.1), in plain Python."""
    leap = calendar.leapdays(since.year, now.year)
    if leap:
        leap += -1 if calendar.isleap(since.year) else 1 if calendar.isleap(now.year) else 0
    delta = now - since - datetime.timedelta(leap)
    left, out = delta.days * 86400 + delta.seconds, []
    if left <= 0:
        return "0 minutes"
    for size, name in ((31536000, "year"), (2592000, "month"), (604800, "week"), (86400, "day"), (3600, "hour"), (60, "minute")):
        n, left = divmod(left, size)
        if out and not n or len(out) == 2:
            break
        if n:
            out.append(f"{n} {name}" + "s" * (n > 1))
    return ", ".join(out) or "0 minutes"


def test_ages_over_leap_years_and_fractions(spark):
    at = datetime.datetime
    rows = [(at(2023, 12, 2), at(2025, 12, 1)), (at(2024, 1, 1), at(2024, 1, 1, 0, 0, 59, 200_000)), (at(2024, 1, 1, 0, 0, 0, 900_000), at(2024, 1, 1, 0, 1)), (at(2000, 3, 1), at(2024, 2, 29)), (at(2024, 2, 29), at(2023, 1, 1))]
    draw = np.random.default_rng(5)
    for a, b in draw.integers(0, 40 * 365 * 86_400 * 1000, (400, 2)):
        rows.append((at(1990, 1, 1) + datetime.timedelta(milliseconds=int(min(a, b))), at(1990, 1, 1) + datetime.timedelta(milliseconds=int(max(a, b)))))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a timestamp_ntz, b timestamp_ntz")
    got = {r.i: r.age.replace(fn.SPACE, " ") for r in frame.select("i", fn.age_in_words(F.col("a"), F.col("b")).alias("age")).collect()}
    assert got == {i: told_age(*r) for i, r in enumerate(rows)}
    assert got[0] == "1 year, 12 months" and got[1] == "0 minutes" and got[2] == "0 minutes"


def test_email_forms(spark):
    good = ["a@b.cd", "u@localhost", "a.b+c@x-y.example.org", '"a\\ b"@x.org', '"a\\"b"@x.org', "u@[127.0.0.1]", "u@[::ffff:0:1]", "u@[1:2:3:4:5:6:7:8]", "x@ünï.example", "a@1.xn--p1ai", "!#$%&'*+/=?^_`{}|~-@x.yz"]
    bad = ["", "a", "@x.org", "a@", "a..b@x.y", "a..b@x.org", ".a@x.org", "a.@x.org", "a b@x.org", "a@b@x.org", "a@x", "a@x.y", "a@-x.org", "a@x-.org", "a@x.or-", "a@x..org", "a@[256.0.0.1]", "a@[1:2]", "a@[::1::2]", "a@x.org\n", "a\n@x.org", "ü@x.org", "a@x_y.org", "a@[1:2:3:4:5:6:7:8:9]", '"a b"@x.org', None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    got = {r.i for r in frame.where(fn.is_email(F.col("t"))).collect()}
    assert got == set(range(len(good))), [(good + bad)[i] for i in got ^ set(range(len(good)))]


def test_uploads_scan_split_store(spark, tmp_path):
    png, jpg = relational_queries.PNG, relational_queries.JPEG
    for name, data in {"a.png": png, "b.jpg": jpg, "c.png": b"no image"}.items():
        (tmp_path / name).write_bytes(data)
    found = uploads.scan_images(spark, f"file://{tmp_path}")
    valid, rejected = uploads.split_uploads(found)
    assert {r.name for r in valid.collect()} == {"a.png", "b.jpg"} and {r.name for r in rejected.collect()} == {"c.png"}
    said = {r.name: (r.detail, r.imageUrl, r.status) for r in uploads.response(found).collect()}
    assert said["a.png"] == ("Image uploaded successfully", "static/a.png", 200) and said["c.png"] == ("Image upload failed", "", 400)
    again = spark.createDataFrame([("x.png", png, 1), ("x.png", png + b"2", 2), ("../y.jpg", jpg, 1)], "name string, content binary, modified long")
    out = tmp_path / "static"
    assert {(r.name, r.bytes) for r in uploads.store(again, str(out)).collect()} == {("x.png", len(png) + 1), ("y.jpg", len(jpg))}
    assert (out / "x.png").read_bytes() == png + b"2"
    assert uploads.scan_images(spark, f"file://{tmp_path}", "*.jpg").count() == 1


def test_json_rows_leave_nulls_out(spark):
    assert json_rows(spark.createDataFrame([(1, None)], "a int, b string")).first().body == '{"a":1}'


def test_describe_interpolates_quartiles(spark):
    got = statistics.describe(spark.createDataFrame([(float(i),) for i in range(1, 12)], "x double"), ["x"]).first()
    assert (got["count"], got.q25, got.q50, got.max) == (11, 3.5, 6.0, 11.0)
    assert statistics.describe(spark.createDataFrame([], "x double"), ["x"]).first()["count"] == 0


def test_describe_leaves_nan_out(spark):
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (None,)], "x double")
    got = statistics.describe(frame, ["x"]).first()
    assert (got["count"], got.q50, got["max"], got["mean"]) == (2, 1.5, 2.0, 1.5)
    with pytest.raises(ValueError):
        statistics.describe(spark.createDataFrame([(1.0,), (float("-inf"),)], "x double"), ["x"])


def test_quantiles_of_many_values(spark, monkeypatch):
    """Several rounds, ties, nulls, few rows and wide ranges, against NumPy."""
    monkeypatch.setattr(statistics, "BUCKETS", 7)
    rng = np.random.default_rng(0)
    columns = rng.lognormal(0, 6, 3000), np.round(rng.standard_normal(3000), 1), np.full(3000, 4.0)
    rows = [(*map(float, r[:2]), float(r[2]) if i % 2 else None, None) for i, r in enumerate(zip(*columns))]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for n in (3000, 2, 1):
        got = {r["column"]: r for r in statistics.describe(frame.limit(n), ["a", "b", "c", "d"]).collect()}
        for c, x in (("a", columns[0][:n]), ("b", columns[1][:n])):
            assert [got[c][q] for q in ("q25", "q50", "q75")] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]).tolist())
        assert got["d"]["count"] == 0 and got["d"].q50 is None
    assert statistics.describe(frame, ["a"], exact=False).first().q50 == pytest.approx(np.median(columns[0]), rel=0.02)


def test_split_of_rows_that_share_an_id_or_have_none(spark, monkeypatch):
    monkeypatch.setattr(statistics, "RANKED", 3)
    frame = spark.createDataFrame([(i % 3 if i % 2 else None, float(i)) for i in range(200)], "k long, x double")
    one, two = (sorted(map(str, statistics.exact_split(frame.repartition(n), "k", 0.3).collect())) for n in (1, 5))
    assert one == two and sum("is_test=True" in r for r in one) == 60


def test_changes_that_repeat_a_key_do_not_multiply_rows(spark):
    rows, changes = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string"), [(1, "x"), (1, "y"), (None, "z"), (3, "w")]
    got = relational.update_by_key(rows, spark.createDataFrame(changes, "k long, v string"), "k").collect()
    assert sorted(got, key=str) == [(1, "y"), (2, "b"), (None, "c")]


def test_missing_profiles_are_made(spark):
    profiles, users = spark.createDataFrame([(9, 1, "en")], "id long, owner long, language string"), spark.createDataFrame([(1,), (2,), (2,), (None,)], "u long")
    got = relational.insert_missing(profiles, users, "owner", "u", language="es").collect()
    assert sorted(map(tuple, got), key=str) == [(9, 1, "en"), (None, 2, "es")]


def test_anova_known_values(spark, sf):
    rows = statistics.anova_f(feature_queries._features(spark, sf)).orderBy(F.desc("f_score")).limit(5).collect()
    assert [r.pos for r in rows] == [60, 31, 5, 51, 25]
    assert [r.f_score for r in rows] == pytest.approx([2.98845, 2.39795, 2.23745, 2.01950, 1.76825], abs=1e-5)


def test_anova_without_variation_is_null(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (0, 1.0, 1), (1, None, 0), (1, 2.0, 1)], "pos int, value double, label int")
    assert all(r.f_score is None for r in statistics.anova_f(df).collect())


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_exact_split_counts(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    split = statistics.exact_split(df, "k", 0.2, seed="s")
    assert split.count() == n and split.where("is_test").count() == math.ceil(0.2 * n - 1e-9)


def test_standardized_columns(spark, vectors, values):
    scaled = matrix.fit_scaler(vectors, "embedding").transform(vectors, "embedding").orderBy("vec_id").select("embedding").collect()
    x = np.array([r[0] for r in scaled])
    assert np.allclose(x, (values - values.mean(0)) / values.std(0))
    flat = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "i long, a double, b double")
    assert sorted(map(tuple, statistics.standard_scores(flat, ["a", "b"]).collect())) == [(1, -1.0, 0.0), (2, 1.0, 0.0)]


def test_moments_leave_odd_vectors_out(spark):
    rows = [([1.0, 2.0],), ([3.0, 6.0],), (None,), ([5.0, None],), ([7.0],)]
    n, mean, cov = matrix.moments(spark.createDataFrame(rows, "v array<double>"), "v", 2)
    assert n == 2 and mean.tolist() == [2, 4] and cov.tolist() == [[1, 2], [2, 4]]


def test_components_match_numpy(spark, vectors, values):
    x = (values - values.mean(0)) / values.std(0)
    scaled = matrix.fit_scaler(vectors, "embedding").transform(vectors, "embedding")
    fitted = matrix.fit_components(scaled, "embedding", 64)
    eigen = np.sort(np.linalg.eigvalsh(x.T @ x))[::-1]
    assert np.allclose(fitted.ratio, eigen / eigen.sum()) and fitted.ratio.sum() == pytest.approx(1)
    assert fitted.needed(0.95) == 1 + (np.cumsum(eigen / eigen.sum()) <= 0.95).sum() == 58
    got = np.array([r[0] for r in fitted.transform(scaled, "embedding", 3).orderBy("vec_id").select("components").collect()])
    assert np.allclose(got, x @ fitted.loadings[:3].T)


def test_ica_finds_sources(spark):
    rng = np.random.default_rng(3)
    s = rng.laplace(size=(3000, 4))
    x = s @ rng.standard_normal((4, 12)) + 0.01 * rng.standard_normal((3000, 12))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    found = matrix.fast_ica(df, "v", 12, 4)
    assert found.converged
    y = np.array([r[0] for r in found.transform(df, "v").orderBy("i").select("sources").collect()])
    corr = np.abs(np.corrcoef(s.T, y.T)[:4, 4:])
    assert (corr.max(axis=1) > 0.99).all() and sorted(corr.argmax(axis=1)) == [0, 1, 2, 3]


def test_ica_query_has_all_rounds(spark, sf, monkeypatch):
    calls, ica = [], matrix.fast_ica

    def noted(*args, **more):
        bound = inspect.signature(ica).bind(*args, **more)
        bound.apply_defaults()
        calls.append(bound.arguments["max_rounds"])
        return ica(*args, **{**more, "max_rounds": 1})

    monkeypatch.setattr(matrix, "fast_ica", noted)
    feature_queries.a9_independent_components(spark, sf)
    feature_queries.a9_vector_components(spark, sf)
    assert calls == [200, 200]


def test_forest_invariants(spark, sf):
    (split, model), (top, small) = feature_queries._forest(spark, sf), feature_queries._small_forest(spark, sf)
    assert sum(r.importance for r in forest.importance(model, split).collect()) == pytest.approx(1) and len(set(top)) == 10
    assert small.numFeatures == 10 and model.numFeatures == 64
    assert all(0 <= r.accuracy <= 1 for r in feature_queries.a6_forest_accuracy(spark, sf).collect())


def test_forest_queries_fit_whole_forests(spark, sf):
    for fitted in (feature_queries._forest(spark, sf)[1], feature_queries._small_forest(spark, sf)[1]):
        assert fitted.getNumTrees == 100 and fitted.getOrDefault("maxDepth") == 30


def test_forests_are_fitted_once(spark, sf, monkeypatch):
    feature_queries.a6_forest_accuracy(spark, sf)
    monkeypatch.setattr(forest, "fit_forest", None)
    assert feature_queries.a7_refit_accuracy(spark, sf).count() == 1 and feature_queries.g9_importance(spark, sf).count() == 64


def test_forests_grow_in_stored_parts(spark, sf):
    """The driver never holds more than one part's trees; votes and importances are those of all parts."""
    rows = forest.with_features(spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 200"), "embedding")
    model = forest.fit_forest(rows, trees=7, depth=4, grown=400)
    parts = [RandomForestClassificationModel.load(p) for p in model.parts]
    assert [p.getNumTrees for p in parts] == [2, 2, 2, 1] and model.getNumTrees == 7
    assert len({t.toDebugString.split("\n", 1)[1] for p in parts for t in p.trees}) == 7
    weighed = sum(p.featureImportances.toArray() * p.getNumTrees for p in parts) / 7
    assert model.featureImportances == pytest.approx(weighed) and sum(model.featureImportances) == pytest.approx(1)
    got = {r.vec_id: r for r in model.transform(rows).collect()}
    want = dict.fromkeys(got, 0)
    for part in parts:
        for r in part.transform(rows).collect():
            want[r.vec_id] = want[r.vec_id] + r.rawPrediction.toArray()
    assert len(got) == 200
    for i, votes in want.items():
        assert got[i].votes == pytest.approx(votes) and sum(votes) == pytest.approx(7) and votes[int(got[i].prediction)] == pytest.approx(max(votes))


def test_smoothing_keeps_the_sum_inside(spark):
    cells = [(x, y, z, 0, 1.0 if (x, y, z) == (3, 3, 3) else 0.0) for x in range(7) for y in range(7) for z in range(7)]
    out = volumes.smooth(spark.createDataFrame(cells, "x int, y int, z int, t int, value double"), fwhm=2)
    got = {(r.x, r.y, r.z): r.value for r in out.collect()}
    assert sum(got.values()) == pytest.approx(1) and len(got) == 343
    ratio = math.exp(-1 / (2 * (2 / math.sqrt(8 * math.log(2))) ** 2))
    assert got[3, 3, 4] / got[3, 3, 3] == pytest.approx(ratio) and got[2, 4, 3] / got[3, 3, 3] == pytest.approx(ratio**2)
    assert [d for d, _ in volumes.gaussian_weights(8, 1)] == list(range(-14, 15))


def test_volume_files(spark, tmp_path):
    cells = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(2, 3, 4, 5)
    (tmp_path / "a.nii").write_bytes(source.encode(cells))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(source.encode(cells + 1)))
    got = {(r.path[-1], r.x, r.y, r.z, r.t): r.value for r in source.scan_volumes(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 240 and all(v == cells[k[1:]] + (k[0] == "z") for k, v in got.items())
    with pytest.raises(ValueError):
        source.decode(b"\0" * 400)


def test_component_queries_run(spark, sf):
    shares = feature_queries.a2_explained_variance(spark, sf).orderBy("component").collect()
    assert len(shares) == 64 and shares[-1].cum_pct == pytest.approx(100)
    assert len(feature_queries.a3_components(spark, sf).first().components) == 58
    assert feature_queries.a4_loadings(spark, sf).count() == 64
    cut = feature_queries.a9_vector_components(spark, sf)
    assert cut.where("value <> 0 and abs(value) < 0.8").count() == 0 and cut.count() == 5000


def test_importance_needs_no_node_in_the_driver(spark, sf, monkeypatch):
    """The importances come from sums of the subtrees' gains; Spark's class, which holds whole trees in the driver, is never asked for."""
    monkeypatch.setattr(forest, "_spark_models", None)
    monkeypatch.setattr(RandomForestClassificationModel, "load", None)
    monkeypatch.setattr(feature_queries, "_fitted", {})
    got = feature_queries.g9_importance(spark, sf).collect()
    assert len(got) == 64 and sum(r.importance for r in got) == pytest.approx(1, abs=1e-4)
    assert [k[0] for k in feature_queries._fitted] == ["all"]


def test_refit_has_the_ten_best_features_alone(spark, sf):
    """The second forest is grown in stored subtrees as well, and votes on every test row once, by all of its trees."""
    top, small = feature_queries._small_forest(spark, sf)
    assert small.subtrees().select("tree").distinct().count() == 100
    split = feature_queries._forest(spark, sf)[0].where("is_test")
    votes = small.transform(forest.with_features(split, "embedding", top)).collect()
    assert len({r.vec_id for r in votes}) == len(votes) == split.count() and all(sum(r.votes) == pytest.approx(100) for r in votes)
    right = sum(r.prediction == r.label for r in votes) / len(votes)
    assert feature_queries.a7_refit_accuracy(spark, sf).first()[0] == pytest.approx(right)


def test_nodes_of_many_rows_are_split_from_summed_histograms(spark, sf):
    """No task has a node of more than ``grown`` rows; Spark's class reads the whole trees and votes alike."""
    rows = forest.with_features(spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 300"), "embedding")
    model = forest.fit_forest(rows, trees=5, depth=6, grown=60)
    assert all(len(top.left) > 1 for top in model.tops)
    sizes = model.subtrees().select(F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n")).collect()
    assert len(sizes) > 10 and max(r.n for r in sizes) <= 60
    got, want, weighed = {r.vec_id: r.votes for r in model.transform(rows).collect()}, {}, 0
    parts = [RandomForestClassificationModel.load(p) for p in model.parts]
    assert [p.getNumTrees for p in parts] == [1] * 5 and all(t.depth == 6 for p in parts for t in p.trees)
    for part in parts:
        weighed = weighed + part.featureImportances.toArray() / 5
        for r in part.transform(rows).collect():
            want[r.vec_id] = want.get(r.vec_id, 0) + r.rawPrediction.toArray()
    assert len(got) == 300 and all(got[i] == pytest.approx(v) for i, v in want.items())
    assert model.featureImportances == pytest.approx(weighed)


def test_every_part_tries_the_root_of_the_features(spark):
    """A part of one tree tries as many features a node as one of many; Spark's learner alone tries all for a single tree."""
    rng = np.random.default_rng(8)
    rows = [(v.tolist(), int(v[0] > 0)) for v in rng.standard_normal((200, 16))]
    df = forest.with_features(spark.createDataFrame(rows, "v array<double>, label int"), "v")
    parts = [RandomForestClassificationModel.load(p) for p in forest.fit_forest(df, trees=8, depth=2, grown=200).parts]
    assert [p.getNumTrees for p in parts] == [1] * 8
    assert sum("If (feature 0 <=" in p.trees[0].toDebugString.split("\n")[1] for p in parts) < 8


def test_forest_splits_are_the_best_ones():
    """A subtree's splits against all splits tried one by one; its leaves hold every row's weight."""
    rng = np.random.default_rng(5)
    bins, y, w = rng.integers(0, 9, (200, 4)).astype(np.uint8), rng.integers(0, 3, 200), rng.integers(1, 4, 200)
    made = trees.grow(bins, y, w, 3, 4, 30, np.random.default_rng(0))

    def score(side):
        counts = np.bincount(y[side], w[side], 3)
        return (counts**2).sum() / counts.sum() if side.any() else 0

    def check(node, rows):
        if made.left[node] < 0:
            held = {c: n for i, c, n in zip(made.leaf, made.cls, made.count) if i == node}
            assert held == {c: w[rows & (y == c)].sum() for c in set(y[rows])}
            return
        sides = [(rows & (bins[:, f] <= b), rows & (bins[:, f] > b)) for f in range(4) for b in range(8)]
        own = bins[:, made.feature[node]] <= made.split[node]
        assert score(rows & own) + score(rows & ~own) == pytest.approx(max(score(x) + score(z) for x, z in sides if x.any() and z.any()))
        check(made.left[node], rows & own), check(made.left[node] + 1, rows & ~own)

    check(0, np.ones(200, bool))


def test_forest_of_separable_classes_is_right(spark):
    """Few values a feature are bins of their own; a large node of one class ends above and still votes."""
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 7), 1.0], i % 3 if i % 3 < 2 else 4) for i in range(600)], "i long, v array<double>, label int")
    model = forest.fit_forest(forest.with_features(rows, "v"), trees=5, depth=8, grown=50)
    got = model.transform(forest.with_features(rows, "v")).collect()
    assert len(got) == 600 and any(top.ends for top in model.tops) and model.classes == 5
    assert sum(r.prediction == r.label for r in got) == 600 and all(sum(r.votes) == pytest.approx(5) for r in got)
    with pytest.raises(ValueError):
        forest.fit_forest(forest.with_features(rows.where("i < 0"), "v"))
