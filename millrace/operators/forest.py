"""Random forests: fit, importance, refit on the best columns."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import trees as grown_trees
from millrace.operators.keyed import free_name
from millrace.sources.batches import bound_batches, lean_worker
from millrace.sources.workspace import discard, materialize, stored_path

#: Rows, repeats counted, of a node whose whole subtree one task grows, and rows times trees of a part that Spark's class loads.
GROWN = 100_000
#: Rows of a block; blocks are dealt out and sent on by node, as a few long binary values.
BLOCK = 4096
#: Rows of a task that deals blocks out.
TASK_ROWS = 20_000
#: Rows times trees that go to a task which grows subtrees, or that these vote on.
SENT = 50_000
#: Bins of a feature at most, as many as Spark's learner has.
BINS = 32
#: Nodes that leave a worker at a time in Spark's form.
NODES = 2000

_TREES = "tree int, node int, size int, counts array<long>, gains array<double>, feature binary, split binary, left binary, leaf binary, cls binary, count binary"
_NODE = (
    "id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, "
    "split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
)
_VOTES = "block long, tree int, node int, at binary, cls binary, vote binary"


def with_features(df: DataFrame, vector: str, positions: Sequence[int] | None = None, out: str = "features") -> DataFrame:
    """Adds the ML vector of an array column, of all positions or of some."""
    values = F.col(vector).cast("array<double>")
    if positions is not None:
        values = F.array(*[F.element_at(values, p + 1) for p in positions])
    return df.withColumn(out, array_to_vector(values))


def _thresholds(known: DataFrame, dim: int) -> list[np.ndarray]:
    """Of each feature the borders of at most BINS bins: between all of its values if they are so few, or else at quantiles of all rows."""
    cells = known.select(F.posexplode("values").alias("pos", "x"))
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    told = cells.groupBy("pos").agg(F.percentile_approx("x", shares, 10_000).alias("q"), F.approx_count_distinct("x", 0.02).alias("n")).collect()
    out = [np.zeros(0)] * dim
    for r in told:
        out[r.pos] = np.unique([q for q in r.q if not math.isnan(q)])
    if few := [r.pos for r in told if r.n <= BINS + BINS // 8]:
        values: dict[int, list[float]] = {}
        for r in cells.where(F.col("pos").isin(few)).distinct().collect():
            values.setdefault(r.pos, []).append(r.x)
        for pos, found in values.items():
            if len(found) <= BINS:
                x = np.sort(found)
                middle = x[:-1] + (x[1:] - x[:-1]) / 2
                out[pos] = np.where(middle < x[1:], middle, x[:-1])
    return out


def _blocks(df: DataFrame, thresholds: list[np.ndarray], other: str, kind: type, tag: str) -> DataFrame:
    """(block, size, other, bins): rows (values, other) as stored blocks, values as the bins that they are in."""
    dim = len(thresholds)
    out = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("other", pa.binary()), ("bins", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                lists = rows.column(0)
                if lists.null_count or set(np.diff(lists.offsets.to_numpy())) != {dim}:
                    raise ValueError(f"features must be vectors of {dim} values")
                bins = grown_trees.bins_of(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), thresholds)
                yield grown_trees.record([[no], [rows.num_rows], [rows.column(1).to_numpy().astype(kind).tobytes()], [bins.tobytes()]], out)
                no += 1

    bound_batches(df.sparkSession)
    return materialize(df.select("values", other).mapInArrow(pack, "block long, size int, other binary, bins binary"), tag)


def _dealt(blocks: DataFrame, rows: int) -> DataFrame:
    """Blocks over tasks of TASK_ROWS rows."""
    return blocks.repartition(math.ceil(rows / TASK_ROWS) or 1, "block")


def _fit_tops(blocks: DataFrame, n: int, count: int, depth: int, seed: int, classes: int, dim: int, tries: int, most: int, memory_mb: int) -> tuple[list[grown_trees.Top], np.ndarray]:
    """Splits nodes of more than ``most`` rows, a level at a time, from histograms that tasks sum; also the gains by tree and feature.

    A task has the histograms of at most ``memory_mb`` at once; if a level has more, its trees go in several passes. Only
    the best split of each node comes to the driver.
    """
    tops, gains = [grown_trees.Top() for _ in range(count)], np.zeros((count, dim))
    large = [(t, 0) for t in range(count)] if n > most else []
    room = max(1, (memory_mb << 20) // (8 * tries * BINS * classes))
    shape = (tries, BINS, classes)
    made = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("counts", pa.binary())])
    found = pa.schema([*list(made)[:2], ("feature", pa.int32()), ("split", pa.int32()), ("gain", pa.float64()), ("on_left", pa.list_(pa.int64())), ("on_right", pa.list_(pa.int64()))])

    def passed(some: list[tuple[int, int]]) -> list:
        wanted: dict[int, set[int]] = {}
        for t, node in some:
            wanted.setdefault(t, set()).add(node)
        own = {t: tops[t] for t in wanted}

        def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean_worker()
            sums: dict[tuple[int, int], np.ndarray] = {}
            for block, size, y, bins in grown_trees.blocks_of(batches, dim, np.int32):
                for t, nodes in wanted.items():
                    w = grown_trees.weights(seed, t, block, size)
                    has = np.flatnonzero(w)
                    for node, at in grown_trees.pieces(own[t].leaf_of(bins[has])):
                        if node in nodes:
                            rows = has[at]
                            one = grown_trees.histogram(bins[rows], y[rows], w[rows], grown_trees.tried(seed, t, node, dim, tries), BINS, classes)
                            sums[t, node] = sums[t, node] + one if (t, node) in sums else one
            for (t, node), one in sums.items():
                yield grown_trees.record([[t], [node], [one.tobytes()]], made)

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            t, node = (k.as_py() for k in key)
            total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in table.column("counts")).reshape(shape)
            best = grown_trees.best_of(total)
            if best is None:
                row = [[t], [node], [-1], [0], [0.0], [total[0].sum(axis=0)], [[]]]
            else:
                row = [[t], [node], [grown_trees.tried(seed, t, node, dim, tries)[best[0]]], [best[1]], [best[2]], [best[3]], [best[4]]]
            return pa.Table.from_batches([grown_trees.record(row, found)])

        sums = _dealt(blocks, n).mapInArrow(count_up, "tree int, node int, counts binary")
        splits = sums.groupBy("tree", "node").applyInArrow(choose, "tree int, node int, feature int, split int, gain double, on_left array<long>, on_right array<long>")
        return sorted(splits.collect(), key=lambda r: (r.tree, r.node))

    while large:
        told = [r for at in range(0, len(large), room) for r in passed(large[at : at + room])]
        large = []
        for r in told:
            top = tops[r.tree]
            if r.feature < 0:
                top.ends[r.node] = list(r.on_left)
                continue
            gains[r.tree, r.feature] += r.gain
            top.feature[r.node], top.split[r.node], top.left[r.node] = r.feature, r.split, len(top.left)
            level = top.level[r.node] + 1
            for counts in (r.on_left, r.on_right):
                node = len(top.left)
                for values, x in ((top.feature, -1), (top.split, 0), (top.left, -1), (top.level, level)):
                    values.append(x)
                if sum(c > 0 for c in counts) == 1 or level >= depth:
                    top.ends[node] = list(counts)
                elif sum(counts) > most:
                    large.append((r.tree, node))
    return tops, gains


def _routed(blocks: DataFrame, rows: int, tops: list[grown_trees.Top], dim: int, kind: type, weigh: int | None) -> DataFrame:
    """(tree, node, block, at, other, weight, bins): of each block and tree the rows of each subtree; with a seed, those that the tree has."""
    out = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("block", pa.int64()), *[(x, pa.binary()) for x in ("at", "other", "weight", "bins")]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for block, size, other, bins in grown_trees.blocks_of(batches, dim, kind):
            for t, top in enumerate(tops):
                w = np.ones(size, np.int32) if weigh is None else grown_trees.weights(weigh, t, block, size).astype(np.int32)
                has = np.flatnonzero(w)
                for node, at in grown_trees.pieces(top.leaf_of(bins[has])):
                    if node not in top.ends:
                        r = has[at]
                        values = [x.tobytes() for x in (r.astype(np.int32), other[r], w[r], bins[r])]
                        yield grown_trees.record([[t], [node], [block], *[[v] for v in values]], out)

    dealt = _dealt(blocks, rows).mapInArrow(deal, "tree int, node int, block long, at binary, other binary, weight binary, bins binary")
    groups = sum(sum(x < 0 for x in top.left) - len(top.ends) for top in tops)
    spread = max(blocks.sparkSession.sparkContext.defaultParallelism, rows * len(tops) // SENT)
    return dealt.repartition(max(1, min(groups, spread)), "tree", "node")


@dataclass(frozen=True)
class Forest:
    """A forest in stored subtrees."""

    spark: SparkSession
    stored: str
    tops: list[grown_trees.Top]
    thresholds: list[np.ndarray]
    classes: int
    getNumTrees: int  # noqa: N815
    maxDepth: int  # noqa: N815
    numFeatures: int  # noqa: N815
    featureImportances: np.ndarray  # noqa: N815
    each: int = 1
    seed: int = 42

    def getOrDefault(self, name: str) -> int:  # noqa: N802
        return getattr(self, name)

    def subtrees(self) -> DataFrame:
        return self.spark.read.schema(_TREES).parquet(self.stored)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``votes``, the classes' shares summed over all trees, and ``prediction``, the first class that has most.

        Rows are sent to the subtrees that they reach, and the subtrees' votes back to the blocks of the rows, where they are summed in
        the trees' order.
        """
        row, dim, classes, tops = free_name(df, "row", ["votes", "prediction", "values"]), self.numFeatures, self.classes, self.tops
        rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "forest-rows")
        blocks = _blocks(rows.select(vector_to_array(features).alias("values"), row), self.thresholds, row, np.int64, "forest-blocks")
        n = blocks.agg(F.sum("size")).first()[0] or 0
        out = pa.schema([("block", pa.int64()), ("tree", pa.int32()), ("node", pa.int32()), ("at", pa.binary()), ("cls", pa.binary()), ("vote", pa.binary())])

        def shares(tree: tuple, leaf: np.ndarray, at: np.ndarray) -> list[bytes]:
            """Which rows vote for which classes by how much; leaves are those of ``tree``: (leaf, class, count), leaves ascending."""
            first, count = np.searchsorted(tree[0], leaf), np.searchsorted(tree[0], leaf, "right") - np.searchsorted(tree[0], leaf)
            of = np.repeat(np.arange(len(leaf)), count)
            entry = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            total = np.bincount(tree[0], tree[2])
            return [x.tobytes() for x in (at[of].astype(np.int32), tree[1][entry].astype(np.int32), tree[2][entry] / total[leaf[of]])]

        def vote(key: tuple, chunks: pa.Table, made: pa.Table) -> pa.Table:
            lean_worker()
            feature, split, left, leaf, cls, count = (grown_trees.numbers(made.column(c), np.int64) for c in ("feature", "split", "left", "leaf", "cls", "count"))
            order = np.argsort(leaf, kind="stable")
            tree, told = (leaf[order], cls[order], count[order]), []
            for block, at, bins in zip(chunks.column("block"), chunks.column("at"), chunks.column("bins")):
                at = np.frombuffer(at.as_buffer(), np.int32)
                reached = grown_trees.descend(np.frombuffer(bins.as_buffer(), np.uint8).reshape(len(at), dim), feature, split, left)
                told.append(grown_trees.record([[block.as_py()], [key[0].as_py()], [key[1].as_py()], *[[x] for x in shares(tree, reached, at)]], out))
            return pa.Table.from_batches(told, out)

        def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, _, bins in grown_trees.blocks_of(batches, dim, np.int64):
                for t, top in enumerate(tops):
                    for node, at in grown_trees.pieces(top.leaf_of(bins) if top.ends else np.zeros(0, np.int64)):
                        if node in top.ends:
                            counts = np.array(top.ends[node])
                            cls = np.flatnonzero(counts)
                            yield grown_trees.record([[block], [t], [node], *[[x] for x in shares((np.zeros(len(cls), np.int64), cls, counts[cls]), np.zeros(len(at), np.int64), at)]], out)

        own = pa.schema([("row", pa.int64()), ("votes", pa.list_(pa.float64())), ("prediction", pa.float64())])

        def summed(key: tuple, votes: pa.Table, block: pa.Table) -> pa.Table:
            lean_worker()
            ids = grown_trees.numbers(block.column("other"), np.int64)
            total = np.zeros((len(ids), classes))
            order = np.lexsort([votes.column("node").to_numpy(), votes.column("tree").to_numpy()])
            at, cls, vote = votes.column("at"), votes.column("cls"), votes.column("vote")
            for i in order:
                total[np.frombuffer(at[i].as_buffer(), np.int32), np.frombuffer(cls[i].as_buffer(), np.int32)] += np.frombuffer(vote[i].as_buffer(), np.float64)
            lists = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * classes, pa.array(total.ravel()))
            return pa.Table.from_arrays([pa.array(ids), lists, pa.array(total.argmax(axis=1).astype(float))], schema=own)

        chunks = _routed(blocks, n, tops, dim, np.int64, None).select("tree", "node", "block", "at", "bins")
        votes = chunks.groupBy("tree", "node").cogroup(self.subtrees().groupBy("tree", "node")).applyInArrow(vote, _VOTES)
        if any(top.ends for top in tops):
            votes = votes.unionByName(_dealt(blocks, n).mapInArrow(ended, _VOTES))
        by_row = votes.groupBy("block").cogroup(blocks.select("block", "other").groupBy("block")).applyInArrow(summed, "row long, votes array<double>, prediction double")
        return rows.join(by_row.withColumnRenamed("row", row), row).drop(row)

    @cached_property
    def parts(self) -> tuple[str, ...]:
        """The forest as models that Spark's ``RandomForestClassificationModel`` loads, ``each`` trees a folder; written when first asked for."""
        return _spark_models(self)


def fit_forest(df: DataFrame, label: str = "label", trees: int = 100, depth: int = 10, seed: int = 42, memory_mb: int = 256, grown: int = GROWN) -> Forest:
    """Each tree has its own draw of all rows, and each node tries as many features as the square root of their number.

    Values are put into bins once. Nodes of more than ``grown`` rows are split from histograms that the tasks sum, all trees
    at once, a level after the other; then the rows of each smaller node go to one task, which grows the whole subtree below.
    So a row is sent once a tree, a task holds ``grown`` rows as bins, and the driver has the few first nodes of each tree. ``memory_mb``
    bounds the histograms of a task and the rows of a subtree.
    """
    known = df.select(vector_to_array("features").alias("values"), F.col(label).cast("double").alias("y"))
    odd = F.col("y").isNull() | (F.col("y") < 0) | (F.col("y") != F.floor("y")) | F.col("values").isNull() | F.exists("values", F.isnan)
    told = known.agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max(F.size("values")).alias("dim"), F.count_if(odd).alias("odd")).first()
    if not told.n or told.odd:
        raise ValueError(f"a forest needs rows with whole labels from 0 and vectors without gaps; {told.odd} of {told.n} are not")
    n, classes, dim = told.n, int(told.y) + 1, told.dim
    tries = math.ceil(math.sqrt(dim)) if trees > 1 else dim
    thresholds = _thresholds(known, dim)
    blocks = _blocks(known.coalesce(math.ceil(n / TASK_ROWS)), thresholds, "y", np.int32, "forest-blocks")
    most = max(1, min(grown, (memory_mb << 20) // dim))
    tops, gains = _fit_tops(blocks, n, trees, depth, seed, classes, dim, tries, most, memory_mb)
    out = StructType.fromDDL(_TREES)
    levels = [top.level for top in tops]

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        lean_worker()
        t, node = (k.as_py() for k in key)
        table = table.take(np.argsort(table.column("block").to_numpy()))
        y, w, bins = (grown_trees.numbers(table.column(c), k) for c, k in (("other", np.int32), ("weight", np.int32), ("bins", np.uint8)))
        rng = np.random.default_rng([seed, 2, t, node])
        made = grown_trees.grow(bins.reshape(len(y), dim), y, w, classes, tries, depth - levels[t][node], rng)
        arrays = [x.astype(np.int64).tobytes() for x in (made.feature, made.split, made.left, made.leaf, made.cls, made.count)]
        row = [t, node, len(made.left), np.bincount(y, w, classes).astype(np.int64), made.gains, *arrays]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), *[pa.binary()] * 6]
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=out.names)

    stored = stored_path(df.sparkSession, "forest")
    _routed(blocks, n, tops, dim, np.int32, seed).groupBy("tree", "node").applyInArrow(grow, out).write.parquet(stored)
    discard(blocks)
    gained = df.sparkSession.read.schema(out).parquet(stored).select("tree", F.posexplode("gains").alias("pos", "x")).groupBy("tree", "pos").agg(F.sum("x").alias("x"))
    for r in gained.collect():
        gains[r.tree, r.pos] += r.x
    # As in Spark: of each tree the shares, of the forest their sum's shares.
    total = (gains / np.maximum(gains.sum(axis=1, keepdims=True), np.finfo(float).tiny)).sum(axis=0)
    each = max(1, min(trees, grown // n))
    return Forest(df.sparkSession, stored, tops, thresholds, classes, trees, depth, dim, total / (total.sum() or 1.0), each, seed)


def _spark_models(model: Forest) -> tuple[str, ...]:
    """Writes the forest in the form of Spark's models: the nodes of the subtrees from the tasks, those above from the driver."""
    spark, each, classes, thresholds = model.spark, model.each, model.classes, model.thresholds
    held = {(r.tree, r.node): r for r in model.subtrees().select("tree", "node", "size", "counts").collect()}
    # A node above keeps its number unless a subtree stands there; subtrees follow, in the order of the nodes.
    base: dict[tuple[int, int], int] = {}
    numbers, firsts = [], []
    for t, top in enumerate(model.tops):
        number, own = {}, [i for i in range(len(top.left)) if (t, i) not in held]
        number.update({node: k for k, node in enumerate(own)})
        at = len(own)
        for i in range(len(top.left)):
            if (t, i) in held:
                number[i] = base[t, i] = at
                at += held[t, i].size
        numbers.append(number)
        counts = {i: np.array(top.ends.get(i) or held[t, i].counts, float) if (t, i) in held or i in top.ends else None for i in range(len(top.left))}
        for i in reversed(own):
            if top.left[i] >= 0:
                counts[i] = counts[top.left[i]] + counts[top.left[i] + 1]
        for i in own:
            c, l = counts[i], top.left[i]
            inner = l >= 0
            gain, split = -1.0, (-1, [], -1)
            if inner:
                a, b = counts[l], counts[l + 1]
                gain = float(grown_trees.impurity_of(c) - (a.sum() * grown_trees.impurity_of(a) + b.sum() * grown_trees.impurity_of(b)) / c.sum())
                split = (top.feature[i], [float(thresholds[top.feature[i]][top.split[i]])], -1)
            children = (number[l], number[l + 1]) if inner else (-1, -1)
            firsts.append((t // each, t % each, (number[i], float(c.argmax()), float(grown_trees.impurity_of(c)), c.tolist(), int(c.sum()), gain, *children, split)))
    schema = f"part int, treeID int, nodeData struct<{_NODE}>"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                feature, split, left, leaf, cls, count = (np.frombuffer(r[c], np.int64) for c in ("feature", "split", "left", "leaf", "cls", "count"))
                counts, start = np.zeros((len(left), classes)), base[r["tree"], r["node"]]
                np.add.at(counts, (leaf, cls), count)
                for i in np.flatnonzero(left >= 0)[::-1]:
                    counts[i] = counts[left[i]] + counts[left[i] + 1]
                n, impurity, inner = counts.sum(axis=1), grown_trees.impurity_of(counts), left >= 0
                a, b = np.where(inner, left, 0), np.where(inner, left + 1, 0)
                gain = np.where(inner, impurity - (n[a] * impurity[a] + n[b] * impurity[b]) / n, -1.0)
                children = [np.where(inner, start + x, -1).astype(np.int32) for x in (left, left + 1)]
                border = [[thresholds[f][b]] if i else [] for f, b, i in zip(feature, split, inner)]
                splits = pa.StructArray.from_arrays(
                    [pa.array(np.where(inner, feature, -1).astype(np.int32)), pa.array(border, pa.list_(pa.float64())), pa.array(np.full(len(left), -1, np.int32))],
                    ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
                )
                stats = pa.ListArray.from_arrays(np.arange(len(left) + 1, dtype=np.int32) * classes, pa.array(counts.ravel()))
                ids = pa.array((start + np.arange(len(left))).astype(np.int32))
                values = [ids, pa.array(counts.argmax(axis=1).astype(float)), pa.array(impurity), stats, pa.array(n.astype(np.int64)), pa.array(gain), *map(pa.array, children), splits]
                nodes = pa.StructArray.from_arrays(values, ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
                of = [pa.array(np.full(len(left), x, np.int32)) for x in (r["tree"] // each, r["tree"] % each)]
                whole = pa.RecordBatch.from_arrays([*of, nodes], ["part", "treeID", "nodeData"])
                yield from (whole.slice(at, NODES) for at in range(0, len(left), NODES))

    base_path, parts = stored_path(spark, "forest-models"), math.ceil(model.getNumTrees / each)
    nodes = model.subtrees().mapInArrow(written, schema)
    nodes = nodes.unionByName(spark.createDataFrame(firsts, schema)) if firsts else nodes
    params = {"impurity": "gini", "maxDepth": model.maxDepth, "seed": model.seed, "maxBins": BINS}
    told = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {}}
    package = "org.apache.spark.ml.classification."
    tree = json.dumps({"class": f"{package}DecisionTreeClassificationModel", **told, "uid": "dtc", "paramMap": params})
    heads = []
    for no in range(parts):
        size = min(each, model.getNumTrees - no * each)
        own = {"class": f"{package}RandomForestClassificationModel", **told, "uid": f"{RandomForestClassifier.__name__}_{no}", "paramMap": {**params, "numTrees": size}}
        heads.append((no, size, json.dumps({**own, "numFeatures": model.numFeatures, "numClasses": classes, "numTrees": size})))
    heads = spark.createDataFrame(heads, "part int, size int, value string").coalesce(1)
    nodes.repartition(min(parts, 200), "part").write.partitionBy("part").parquet(f"{base_path}/data")
    heads.select("part", "value").write.partitionBy("part").text(f"{base_path}/metadata")
    each_tree = heads.select("part", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("_1"), F.lit(tree).alias("_2"), F.lit(1.0).alias("_3"))
    each_tree.write.partitionBy("part").parquet(f"{base_path}/treesMetadata")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base_path).getFileSystem(spark._jsc.hadoopConfiguration())
    for no in range(parts):
        files.mkdirs(path(f"{base_path}/{no}"))
        for kind in ("data", "metadata", "treesMetadata"):
            if not files.rename(path(f"{base_path}/{kind}/part={no}"), path(f"{base_path}/{no}/{kind}")):
                raise OSError(f"{base_path}/{kind}/part={no} can't be renamed")
    return tuple(f"{base_path}/{no}" for no in range(parts))


def importance(model: Forest, df: DataFrame) -> DataFrame:
    """(pos, importance), largest first; the importances sum to 1."""
    rows = [(i, float(x)) for i, x in enumerate(model.featureImportances)]
    return df.sparkSession.createDataFrame(rows, "pos int, importance double").orderBy(F.desc("importance"), "pos")
