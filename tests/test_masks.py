"""Masks, series and geometry of image volumes, against NumPy."""

import gzip
import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import masks, matrix, volumes
from millrace.plans import feature_queries
from millrace.sources import volumes as source
from millrace.sources.batches import BATCH

STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def shifted(mask, step):
    """A mask moved by a step, nothing coming in from outside."""
    out = np.zeros_like(mask)
    into = tuple(slice(max(0, d), mask.shape[a] + min(0, d)) for a, d in enumerate(step))
    from_ = tuple(slice(max(0, -d), mask.shape[a] + min(0, -d)) for a, d in enumerate(step))
    out[into] = mask[from_]
    return out


def np_eroded(mask, times):
    for _ in range(times):
        mask = np.logical_and.reduce([mask, *(shifted(mask, s) for s in STEPS)])
    return mask


def np_dilated(mask, times):
    for _ in range(times):
        mask = np.logical_or.reduce([mask, *(shifted(mask, s) for s in STEPS)])
    return mask


def np_components(mask):
    """Flood fill; label and voxels of each component, in the order of z, y and x."""
    left, out = mask.copy(), []
    for z, y, x in sorted((z, y, x) for x, y, z in zip(*np.nonzero(mask))):
        if left[x, y, z]:
            stack, own = [(x, y, z)], set()
            left[x, y, z] = False
            while stack:
                at = stack.pop()
                own.add(at)
                for s in STEPS:
                    to = tuple(a + d for a, d in zip(at, s))
                    if all(0 <= a < n for a, n in zip(to, mask.shape)) and left[to]:
                        left[to] = False
                        stack.append(to)
            out.append(own)
    return out


def np_epi_mask(mean, opening, lower=0.2, upper=0.85):
    ranked = np.sort(np.nan_to_num(mean, nan=0.0).ravel())
    low, high = math.floor(lower * len(ranked)), min(math.floor(upper * len(ranked)), len(ranked) - 1)
    widths = ranked[low + 1 : high + 1] - ranked[low:high]
    at = low + int(widths.argmax())
    mask = np_eroded(np.nan_to_num(mean, nan=0.0) >= (ranked[at] + ranked[at + 1]) / 2, opening)
    found = np_components(mask)
    mask = np.zeros_like(mask)
    for place in max(found, key=len, default=()):
        mask[place] = True
    return np_eroded(np_dilated(mask, 2 * opening), opening)


def phantom(seed, shape=(14, 12, 10)):
    """A bright ball with a thin bridge to a smaller body, specks, and noise."""
    rng = np.random.default_rng(seed)
    at = np.indices(shape)
    mean = rng.normal(0, 1, shape)
    mean[sum((a - c) ** 2 for a, c in zip(at, (5, 6, 5))) <= 16] += 50
    mean[9:13, 6, 5] += 50
    mean[12:14, 4:9, 3:8] += 50
    for p in rng.integers(0, 10, (6, 3)):
        mean[tuple(p)] += 50
    return mean


def rows_of(values, *keys):
    return [(*keys, *map(int, p), float(v)) for p, v in np.ndenumerate(values) for p in [p]]


def places(frame, shape, **key):
    out = np.zeros(shape, dtype=bool)
    for c, v in key.items():
        frame = frame.where(F.col(c) == v)
    got = [(r.x, r.y, r.z) for r in frame.collect()]
    assert len(got) == len(set(got))
    for p in got:
        out[p] = True
    return out


@pytest.mark.parametrize("opening", [0, 1, 2])
def test_epi_mask_matches_numpy(spark, opening):
    means = {n: phantom(n) for n in (1, 2)}
    means[2][0, 0, 0] = np.nan
    frame = spark.createDataFrame([r for n, m in means.items() for r in rows_of(m, f"img{n}")], "path string, x int, y int, z int, mean_value double").repartition(3)
    got = masks.epi_mask(frame, ["path"], opening=opening)
    for n, m in means.items():
        assert (places(got, m.shape, path=f"img{n}") == np_epi_mask(m, opening)).all()
    alone = frame.where("path = 'img1'").drop("path")
    assert (places(masks.epi_mask(alone, opening=opening), means[1].shape) == np_epi_mask(means[1], opening)).all()


def test_masks_of_odd_images(spark):
    kind = "x int, y int, z int, mean_value double"
    assert masks.epi_mask(spark.createDataFrame([], kind)).count() == 0
    assert masks.epi_mask(spark.createDataFrame([], "p string, " + kind), ["p"]).count() == 0
    one = spark.createDataFrame([(0, 0, 0, 5.0)], kind)
    assert masks.gap_threshold(one).first().threshold == 5 and masks.epi_mask(one, opening=0).count() == 1 and masks.epi_mask(one).count() == 0
    flat = spark.createDataFrame([(x, y, 0, None if x else float("inf")) for x in range(4) for y in range(4)], kind)
    assert masks.gap_threshold(flat).first().threshold == 0 and masks.epi_mask(flat, opening=0).count() == 16
    ties = spark.createDataFrame([(i, 0, 0, float(v)) for i, v in enumerate((0, 0, 1, 2, 3, 3, 3))], kind)
    assert masks.gap_threshold(ties, lower=0, upper=1).first().threshold == 0.5  # the first of three equal gaps


def test_components_of_a_spiral_and_of_equal_bodies(spark):
    """A long thin body, which labels must follow to its end, and two bodies of one size, of which the first counts."""
    n, turn = 21, np.zeros((21, 21), dtype=bool)
    x, y, dx, dy, left = 0, 0, 1, 0, n - 1
    turn[0, 0] = True
    for leg in range(18):
        for _ in range(left):
            x, y = x + dx, y + dy
            turn[x, y] = True
        dx, dy = -dy, dx
        left -= 2 if leg and leg % 2 == 0 else 0
        if left <= 0:
            break
    mask = np.zeros((21, 21, 3), dtype=bool)
    mask[:, :, 1] = turn
    frame = spark.createDataFrame([tuple(map(int, p)) for p in zip(*np.nonzero(mask))], "x int, y int, z int")
    want = np_components(mask)
    runs = masks.component_runs(frame).collect()
    assert len({r.component for r in runs}) == len(want) and {r["size"] for r in runs} == {len(w) for w in want}
    two = spark.createDataFrame([(0, 5, 0), (1, 5, 0), (7, 0, 0), (8, 0, 0), (4, 0, 1)], "x int, y int, z int")
    assert sorted(tuple(r) for r in masks.largest_component(two).collect()) == [(7, 0, 0), (8, 0, 0)]


def axis_kernel(n, fwhm, edge):
    weights = dict(volumes.gaussian_weights(fwhm, edge))
    return np.array([[weights.get(i - j, 0.0) for j in range(n)] for i in range(n)])


def np_smooth(values, fwhm, edges):
    for axis, edge in enumerate(edges):
        values = np.moveaxis(np.tensordot(axis_kernel(values.shape[axis], fwhm, edge), values, (1, axis)), 0, axis)
    return values


def test_kernels_by_the_edges_of_an_image(spark):
    """Two images of other voxel sizes at once, each axis with its own kernel, and the weights against their formula."""
    rng, edges = np.random.default_rng(1), {"a": [2.0, 3.0, 6.0], "b": [4.0, 4.0, 4.0]}
    cells = {p: rng.normal(size=(6, 5, 4, 3)) for p in edges}
    rows = [(p, *map(int, at), float(v), edges[p]) for p, c in cells.items() for at, v in np.ndenumerate(c)]
    frame = spark.createDataFrame(rows, "path string, x int, y int, z int, t int, value double, voxel array<double>").repartition(4)
    series = volumes.to_series(frame, ["path"]).join(frame.select("path", "voxel").distinct(), "path")
    out = volumes.smooth_series(series, 8.0, "voxel", ["path"])
    got = {(r.path, r.x, r.y, r.z): r.series for r in out.collect()}
    for p, c in cells.items():
        want = np_smooth(c, 8.0, edges[p])
        assert all(np.allclose(got[p, *at], want[at]) for at in np.ndindex(c.shape[:3]))
    sigma = 8 / 3 / math.sqrt(8 * math.log(2))
    weights = dict(volumes.gaussian_weights(8, 3))
    assert max(weights) == math.floor(4 * sigma + 0.5) and weights[2] / weights[0] == pytest.approx(math.exp(-4 / (2 * sigma**2)))
    plain = volumes.smooth(frame.where("path = 'a'").drop("voxel"), 8.0, (2.0, 3.0, 6.0))
    want = np_smooth(cells["a"], 8.0, edges["a"])
    assert all(r.value == pytest.approx(want[r.x, r.y, r.z, r.t]) for r in plain.collect()) and plain.schema["t"].dataType.simpleString() == "int"


def test_long_lines_are_smoothed_in_pieces(spark, monkeypatch):
    """A line of any length leaves in spans that do not grow with it, each with what the kernel reaches beside it; gaps may be longer than that."""
    rng = np.random.default_rng(4)
    cells = rng.normal(size=(2, 3, 900, 2))
    gone = rng.random((2, 3, 900)) < 0.2
    gone[:, :, 300:640] = True
    rows = [(*map(int, at), t, float(cells[at][t])) for at in np.ndindex(gone.shape) if not gone[at] for t in range(2)]
    frame = spark.createDataFrame(rows, "x int, y int, z int, t int, value double")
    want = np_smooth(np.where(gone[..., None], 0.0, cells), 9.0, (3.0, 3.0, 3.0))
    for piece in (volumes.PIECE, 7, 1):
        monkeypatch.setattr(volumes, "PIECE", piece)
        got = {(r.x, r.y, r.z): r.series for r in volumes.smooth_series(volumes.to_series(frame), 9.0, 3.0).collect()}
        assert set(got) == {tuple(map(int, at)) for at in np.argwhere(~gone)} and all(np.allclose(v, want[k]) for k, v in got.items())
    along = volumes._along
    monkeypatch.setattr(volumes, "PIECE", 256)
    monkeypatch.setattr(volumes, "_along", lambda *args: lambda batches, run=along(*args): noted(run, batches))

    def noted(run, batches):
        for batch in batches:
            for line in batch.column(batch.num_columns - 1):
                assert len(line) <= 256 + 2 * 7
            yield from run([batch])

    assert volumes.smooth_series(volumes.to_series(frame), 9.0, 3.0).count() == int((~gone).sum())


def test_files_reach_workers_in_bounded_batches(spark):
    """Not all files of a partition at once, but 8 MB of them, or one larger one."""
    files = spark.range(6, numPartitions=1).select(F.concat(F.lit("f"), F.col("id")).alias("path"), F.lit(bytes(5 << 20)).alias("content"))
    before = {c: spark.conf.get(c) for c in BATCH}
    try:
        for c in BATCH:
            spark.conf.unset(c)
        source.volume_rows(files)
        held = files.mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n long").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(r.n for r in held) == 6 and max(r.n for r in held) <= 2


def test_smoothing_around_absent_voxels(spark):
    """What is spread to a place without a voxel is spread on from there, as in an array that has 0 there."""
    rng = np.random.default_rng(7)
    cells = rng.normal(size=(5, 4, 6, 2))
    gone = rng.random((5, 4, 6)) < 0.4
    gone[:, 2, :] = True
    rows = [(*map(int, at), t, float(cells[at][t])) for at in np.ndindex(gone.shape) if not gone[at] for t in range(2)]
    out = volumes.smooth(spark.createDataFrame(rows, "x long, y int, z short, t int, value double"), 6.0, (2.0, 3.0, 4.0))
    want = np_smooth(np.where(gone[..., None], 0.0, cells), 6.0, (2.0, 3.0, 4.0))
    got = {(r.x, r.y, r.z, r.t): r.value for r in out.collect()}
    assert set(got) == {r[:4] for r in rows} and all(v == pytest.approx(want[k]) for k, v in got.items())
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "int", "smallint", "int", "double"]
    assert volumes.smooth(out.where("false"), 6.0).count() == 0


def test_series_of_missing_steps(spark):
    rows = [(0, 0, 0, 0, 1.0), (0, 0, 0, 2, 3.0), (1, 0, 0, 1, None), (1, 0, 0, 2, float("nan")), (1, 0, 0, 2, -1.0), (2, 0, 0, -1, 9.0), (2, 0, 0, None, 9.0), (2, 0, 0, 7, 9.0), (2, 0, 0, 0, 4.0)]
    frame = spark.createDataFrame(rows, "x int, y int, z int, t int, value double")
    got = {r.x: r.series for r in volumes.to_series(frame, steps=3).collect()}
    assert got == {0: [1.0, None, 3.0], 1: [None, 0.0, 0.0], 2: [4.0, None, None]}
    assert len(volumes.to_series(frame).first().series) == 8
    back = sorted((r.x, r.t, r.value) for r in volumes.from_series(volumes.to_series(frame, steps=3)).collect())
    assert back == [(0, 0, 1.0), (0, 2, 3.0), (1, 1, 0.0), (1, 2, 0.0), (2, 0, 4.0)]
    assert {r.x: r.series for r in volumes.filled(volumes.to_series(frame, steps=3)).collect()}[0] == [1.0, 0.0, 3.0]
    scored = {r.x: r.series for r in volumes.standardize_series(volumes.to_series(frame, steps=3)).collect()}
    assert scored == {0: [-1.0, None, 1.0], 1: [None, 0.0, 0.0], 2: [0.0, None, None]}
    assert volumes.to_series(frame.where("false")).count() == 0
    smoothed = {r.x: r.series for r in volumes.smooth_series(volumes.to_series(frame, steps=3), 2.0).collect()}
    w = dict(volumes.gaussian_weights(2.0))
    assert smoothed[0][1] is None and smoothed[0][0] == pytest.approx((w[0] * 1.0 + w.get(2, 0.0) * 4.0) * w[0] ** 2)


def test_vectors_go_back_to_their_voxels(spark):
    space = spark.createDataFrame([(x, 0, 0, t) for x in range(3) for t in range(2)], "x int, y int, z int, t int")
    inside = spark.createDataFrame([(1, 0, 0, [5.0, 6.0])], "x int, y int, z int, series array<double>")
    got = sorted((r.x, r.component, r.value) for r in volumes.inverse_series(inside, space).collect())
    assert got == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 5.0), (1, 1, 6.0), (2, 0, 0.0), (2, 1, 0.0)]


def np_heads(spark, sf):
    """The phantom heads of the queries, as arrays; places without a vector are NaN."""
    out = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        v = r.vec_id
        x, y, z = v % 8, v // 8 % 8, v // 64 % 8
        bright = 6.0 if (x - 3.5) ** 2 + (y - 3.5) ** 2 + (z - 3.5) ** 2 <= 10 or v % 89 == 0 else 0.0
        out.setdefault(v // 512, np.full((8, 8, 8, len(r.embedding)), np.nan))[x, y, z] = np.array(r.embedding, dtype=float) + bright
    return out


def test_from_files_to_component_volumes(spark, sf):
    """The whole lesson against NumPy: mask, smoothing, scores, components (up to rounding of the iteration), threshold, back to space."""
    inside, rows = {}, []
    for image, cells in np_heads(spark, sf).items():
        mask = np_epi_mask(cells.mean(axis=3), 1) & ~np.isnan(cells[..., 0])
        smoothed = np_smooth(np.nan_to_num(cells, nan=0.0), 8.0, (4.0, 4.0, 5.0))[mask]
        rows.append((smoothed - smoothed.mean(axis=1, keepdims=True)) / smoothed.std(axis=1, keepdims=True))
        inside[image] = mask
    x = np.concatenate(rows)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    top = np.argsort(-values)[:10]
    z = centred @ (vectors[:, top] / np.sqrt(values[top]))

    def apart(w):
        s, u = np.linalg.eigh(w @ w.T)
        return (u / np.sqrt(s)) @ u.T @ w

    w = apart(np.random.default_rng(42).standard_normal((10, 10)))
    for rounds in range(200):
        g = np.tanh(z @ w.T)
        new = apart(g.T @ z / len(z) - (1 - g * g).mean(axis=0)[:, None] * w)
        change, w = np.abs(np.abs((new * w).sum(axis=1)) - 1).max(), new
        if change <= 1e-4:
            break
    sources = z @ w.T
    frame = feature_queries.a9_independent_components(spark, sf)
    got = {}
    for r in frame.collect():
        got.setdefault((r.image, r.x, r.y, r.z), {})[r.component] = r.value
    assert len(got) == sum(int((~np.isnan(c[..., 0])).sum()) for c in np_heads(spark, sf).values()) and all(len(v) == 10 for v in got.values())
    at = [(i, *map(int, p)) for i, m in inside.items() for p in zip(*np.nonzero(m))]
    outside = [v for k, v in got.items() if k not in set(at)]
    assert outside and all(set(v.values()) == {0.0} for v in outside)
    found = np.array([[got[k][c] for c in range(10)] for k in at])
    assert not ((found != 0) & (np.abs(found) < 0.8)).any()
    if change <= 1e-4:
        # Sign and order are free; the sources of both agree one to one before they are normalised and cut.
        series = volumes.mask_series(*_head_parts(spark, sf), fwhm=8, voxel="voxel", keys=["image"])
        ica = matrix.fast_ica(volumes.filled(series), "series", x.shape[1], 10)
        assert ica.converged
        own = np.array([r.sources for r in ica.transform(series, "series").orderBy("image", "x", "y", "z").collect()])
        corr = np.abs(np.corrcoef(own.T, sources.T)[:10, 10:])
        assert (corr.max(axis=1) > 0.99).all() and sorted(corr.argmax(axis=1)) == list(range(10))


def _head_parts(spark, sf):
    volume, _, mask = feature_queries._head(spark, sf)
    return volume, mask


TURN = np.array([[0.0, -2.0, 0.0, 10.0], [1.8, 0.0, 0.0, -20.0], [0.0, 0.0, 3.0, 30.0], [0, 0, 0, 1]])


def test_geometry_of_headers(spark, tmp_path):
    cells = np.arange(24.0).reshape(2, 3, 4, 1)
    slanted = np.eye(4)
    a, b, c = 0.4, -0.7, 1.1
    turn = lambda i, j, w: np.array([[math.cos(w) if k == m and k in (i, j) else -math.sin(w) if (k, m) == (i, j) else math.sin(w) if (k, m) == (j, i) else float(k == m) for m in range(3)] for k in range(3)])
    slanted[:3, :3] = turn(0, 1, a) @ turn(1, 2, b) @ turn(0, 2, c) * [2.0, 2.5, 3.5]
    slanted[:3, 3] = 1, -2, 3
    mirrored = slanted.copy()
    mirrored[:3, 2] *= -1
    for affine in (TURN, slanted, mirrored):
        for quaternion in (False, True):
            found = source.geometry(source.encode(cells, affine, 2.5, quaternion))
            assert np.allclose(found["affine"], affine, atol=1e-5) and found["dims"] == [2, 3, 4, 1] and found["t_step"] == 2.5
            assert np.allclose(found["voxel"], np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), atol=1e-5)
    plain = bytearray(source.encode(cells))
    struct.pack_into("<4f", plain, 76, 1.0, 3.0, 0.0, float("nan"))
    assert source.geometry(bytes(plain))["voxel"] == [3.0, 1.0, 1.0] and np.allclose(source.decode(bytes(plain)), cells)
    (tmp_path / "a.nii").write_bytes(source.encode(cells, TURN))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(source.encode(cells, slanted)))
    folder = f"file://{tmp_path}"
    known = source.volume_geometry(source.scan_files(spark, folder))
    placed = {(r.path[-1], r.x, r.y, r.z): (r.x_mm, r.y_mm, r.z_mm) for r in source.to_millimetres(source.scan_volumes(spark, folder), known).collect()}
    for end, affine in (("i", TURN), ("z", slanted)):
        assert np.allclose(placed[end, 1, 2, 3], (affine @ [1, 2, 3, 1])[:3], atol=1e-4)
    with pytest.raises(ValueError):
        source.geometry(b"short")
