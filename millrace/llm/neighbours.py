"""Nearest neighbours by inner product: a forest of random-projection trees, then exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import join_sized, materialize, sized_broadcast

#: Trees, and entries that a leaf is to hold; the depth follows from the number of entries.
TREES, LEAF = 3, 64
#: Leaves that every query opens before it has a bound.
FIRST = 8
#: How far beyond the expected crossing of a cut a query looks; sets recall against work.
SLACK = 1.8
#: Vectors that the cuts are fitted on, and those that a node needs for a cut of its own; every vector is indexed.
FIT_ROWS, FIT_NODE = 50_000, 32
#: log2 of the leaves that form a shard; members and queries of a shard that a task holds at a time.
SHARD, MEMBERS, QUERIES, STEP = 7, 8192, 4096, 256


class Forest:
    """Each level of a tree has one random direction, and each node splits at its median along it.

    Below the levels where the sample still has FIT_NODE vectors a node, a level has one cut, its median over the
    whole sample. So the forest is small whatever its depth. Leaf numbers are unique over all trees.
    """

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> None:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.trees, self.depth = trees, max(0, math.ceil(math.log2(max(rows, 1) / leaf)))
        fitted = min(self.depth, int(math.log2(max(len(sample) / FIT_NODE, 1))))
        self.normals = rng.standard_normal((trees, self.depth, dim))
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.cuts: list[list[np.ndarray]] = []
        for t in range(trees):
            side, node, levels = sample @ self.normals[t].T, np.zeros(len(sample), dtype=np.int64), []
            for level in range(self.depth):
                own = side[:, level]
                if level < fitted:
                    ends = np.searchsorted(node[by := np.argsort(node, kind="stable")], np.arange((1 << level) + 1))
                    levels.append(np.array([np.median(own[by[a:b]]) if b > a else 0.0 for a, b in zip(ends, ends[1:])]))
                    node = 2 * node + (own > levels[-1][node])
                else:
                    levels.append(np.array([np.median(own) if len(own) else 0.0]))
            self.cuts.append(levels)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector (row) in each tree (column)."""
        out = np.empty((len(vectors), self.trees), dtype=np.int64)
        for t in range(self.trees):
            side, node = vectors @ self.normals[t].T, np.zeros(len(vectors), dtype=np.int64)
            for level, cuts in enumerate(self.cuts[t]):
                node = 2 * node + (side[:, level] > (cuts[node] if len(cuts) > 1 else cuts[0]))
            out[:, t] = node + (t << self.depth)
        return out

    def opened(self, query: np.ndarray, limit: float = math.inf) -> Iterator[int]:
        """Leaves of all trees from one priority queue: least sum of squared distances to the cuts crossed, up to a limit."""
        sides = (self.normals @ query).tolist()
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        while queue:
            far, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                cuts = self.cuts[t][level]
                margin = sides[t][level] - float(cuts[node] if len(cuts) > 1 else cuts[0])
                level, node = level + 1, 2 * node + (margin > 0)
                if (crossed := far + margin * margin) <= limit:
                    heapq.heappush(queue, (crossed, t, level, node ^ 1))
            yield node + (t << self.depth)

    def enough(self, query: np.ndarray, limit: float) -> np.ndarray:
        """The leaves that are opened up to a limit, or else, once they are as many as a tree has, all leaves of one tree: these
        hold every entry, once each, which is less work than the same entries from several trees."""
        found = np.fromiter(islice(self.opened(query, limit), 1 << self.depth), np.int64)
        return found if len(found) < 1 << self.depth else np.arange(1 << self.depth) + (np.bincount(found[:FIRST] >> self.depth).argmax() << self.depth)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """One more component brings every vector to length ``norm``; then the largest inner product is the least distance."""
    return np.column_stack([vectors, np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))])


def _scaled(queries: np.ndarray, norm: float) -> np.ndarray:
    """Queries of length ``norm``, which leaves the order of their neighbours as it is."""
    return np.column_stack([queries * (norm / np.linalg.norm(queries, axis=1, keepdims=True)), np.zeros(len(queries))])


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, float]:
    """(id, v) of the rows that take part, the dimension that most of them have, and the largest length of a vector."""
    single = rows.schema[vec_col].dataType.simpleString() == "array<float>"
    v = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    known = rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & some)
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    size = known.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("most")).orderBy(F.desc("n"), "dim").first()
    dim, norm = (size.dim, math.sqrt(size.most)) if size else (1, 1.0)
    return known.where(F.size("v") == dim), dim, norm


def _best(near: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest values of every row from ``least`` on, and of those that rounding may tie with them."""
    if near.shape[1] > k:
        least = np.maximum(least, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
    least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), least)
    return np.nonzero((near >= least[:, None]) & np.isfinite(near))


def _scorer(dim: int, k: int):
    """Scores the queries of a shard against the members of the leaves that they open; the k best of each leave it, if
    they are no worse than what the query has."""

    def score(_, left: pa.Table, right: pa.Table) -> pa.Table:
        who, what, scores = [], [], []
        if left.num_rows and right.num_rows:
            leaf = np.asarray(left.column("leaf").combine_chunks())
            left = left.take(pa.array(by := np.argsort(leaf, kind="stable")))
            leaf, vectors = leaf[by], _matrix(left.column("v").combine_chunks(), dim)
            names, starts = np.unique(leaf, return_index=True)
            ends, queries = np.r_[starts[1:], len(leaf)], _matrix(right.column("v").combine_chunks(), dim)
            place = np.asarray(pc.rank(left.column("e").combine_chunks(), tiebreaker="dense")).astype(np.int64)
            lists, has = right.column("leaves").combine_chunks(), np.asarray(right.column("has"))
            asks, wants = np.asarray(pc.list_parent_indices(lists)), np.asarray(lists.flatten())
            for at in range(0, len(queries), STEP):
                q = queries[at : at + STEP]
                own = (asks >= at) & (asks < at + STEP)
                near, by = np.full((len(q), len(vectors)), -np.inf), np.argsort(wants[own], kind="stable")
                asked, wanted = asks[own][by] - at, wants[own][by]
                for a, b, *span in zip(starts, ends, np.searchsorted(wanted, names), np.searchsorted(wanted, names, "right")):
                    if len(rows := asked[slice(*span)]):
                        near[rows, a:b] = q[rows] @ vectors[a:b].T
                i, j = _best(near, k, has[at : at + STEP])
                exact = (q[i] * vectors[j]).sum(axis=1)  # the same sum for a pair in whatever block
                order = np.lexsort((place[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, i)
                keep = (np.arange(len(i)) - first < k) & (exact >= has[at : at + STEP][i])
                who.append(i[keep] + at)
                what.append(j[keep])
                scores.append(exact[keep])
        at, of, how = (np.concatenate(x) if x else np.zeros(0, dtype) for x, dtype in ((who, np.int64), (what, np.int64), (scores, float)))
        return pa.table({"q": right.column("e").take(pa.array(at)), "e": left.column("e").take(pa.array(of)), "score": pa.array(how)})

    return score


def index(entries: DataFrame, dim: int, norm: float, trees: int = TREES, leaf: int = LEAF, fit_rows: int = FIT_ROWS) -> Forest:
    """A forest for entries (e, v), fitted on about ``fit_rows`` of them, drawn by a hash of e."""
    n = entries.count()
    draw = F.pmod(F.xxhash64("e", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / max(n, 1)))
    sample = entries.where(draw).select("v").toArrow().column(0).combine_chunks() if n else None
    return Forest(_lifted(_matrix(sample, dim), norm) if n else np.zeros((0, dim + 1)), n, trees, leaf)


def _shards(forest: Forest, df: DataFrame, kind: str, vector: str, dim: int, lists) -> DataFrame:
    """(shard, e, v, has, leaves): each row (e, v, has) once a shard; ``lists`` gives from a batch each row's leaves, ascending."""
    bits = min(forest.depth, SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = lists(batch)
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            if not len(row):
                continue
            leaf = np.concatenate(found)
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | ((leaf[1:] >> bits) != (leaf[:-1] >> bits))])
            at = pa.array(row[new])
            held = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array(leaf))
            columns = [pa.array(leaf[new] >> bits), *(batch.column(i).take(at) for i in range(3)), held]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "e", "v", "has", "leaves"])

    return df.mapInArrow(run, f"shard long, e {kind}, v {vector}, has double, leaves array<long>")


def nearest(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    slack: float = SLACK,
    fit_rows: int = FIT_ROWS,
    leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank from 1, ``id_col``, score): each query's k nearest found, by inner product in double precision.

    Equal vectors are one entry of the index with their k + 1 smallest ids, so a vector that fills a third of the
    table is compared once. Entries are lifted to one length, where the largest inner product is the least distance,
    and every entry is a member of one leaf of about ``leaf`` entries in each tree.

    A query takes leaves of all trees from one priority queue. The first FIRST of them give it k neighbours at some
    distance D. A neighbour at distance D in a direction of its own lies about D / sqrt(dim) off along any normal, so
    the queue goes on until the squared cuts crossed sum to more than slack * D**2 / dim. Vectors with structure need few
    leaves. Vectors without any would need most leaves of all trees; once a query has opened as many leaves as a tree
    has, it takes all leaves of one tree instead, so it is never compared with more than all entries and its FIRST leaves, and
    then its answer is exact. Queries go to shards of neighbouring leaves, once each with the list of
    leaves they open; members and queries of a shard meet in blocks of bounded size and are scored exactly. What is worse
    than the k + 1 that a query has from its first leaves does not leave a block.

    Cases: rows whose id or vector is null, zero or holds a null or non-finite component take no part. Inner products
    of vectors of different lengths are undefined: vectors of another length than most (the shorter one if equally
    many) take no part either. A query's own id is no candidate; other rows with an equal vector are. Ties go to the
    smaller id. Repeated rows count once. With k or fewer others all are returned; an empty table, or no query, gives
    an empty result. Other columns are ignored.
    """
    known, dim, norm = usable(rows, id_col, vec_col)
    kind, vector = (known.schema[c].dataType.simpleString() for c in ("id", "v"))
    known = known.dropDuplicates(["id", "v"])  # so that ranks, which are limited before the shuffle, are no row's twice
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = known.withColumn("copy", copies).where(F.col("copy") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    entries = materialize(entries.select(F.col("ids")[0].alias("e"), "ids", "v"), "ann-entries")
    asked = known.join(rows.where(is_query).select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    asked = materialize(asked, "ann-asked")
    met = materialize(asked.groupBy("v").agg(F.count("*").alias("n")).join(entries.select("e", "v"), "v"), "ann-asked-vectors")
    asked = materialize(join_sized(asked, met, "v", deal=F.xxhash64("id")).select("id", "e").distinct(), "ann-queries")
    queries = materialize(entries.join(asked.select("e").distinct(), "e", "left_semi").select("e", "v"), "ann-vectors")
    forest = index(entries, dim, norm, leaf=leaf, fit_rows=fit_rows)

    def homes(batch: pa.RecordBatch) -> np.ndarray:
        return forest.leaves(_lifted(_matrix(batch.column(1), dim), norm))

    def first(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.sort(np.fromiter(islice(forest.opened(q), FIRST), np.int64)) for q in _scaled(_matrix(batch.column(1), dim), norm)]

    def others(batch: pa.RecordBatch) -> list[np.ndarray]:
        queries, limits = _scaled(_matrix(batch.column(1), dim), norm), batch.column(3).to_pylist()
        return [np.setdiff1d(forest.enough(q, far), f) for q, far, f in zip(queries, limits, first(batch))]

    nothing = F.lit(-math.inf).alias("has")
    members = _shards(forest, entries.select("e", "v", nothing), kind, vector, dim, homes)
    members = materialize(members.select("shard", "e", "v", F.col("leaves")[0].alias("leaf")), "ann-members")

    def search(seekers: DataFrame) -> DataFrame:
        """(q, e, score): the k + 1 best of every block, from the score on that a query has."""
        size = lambda df, most, name: df.groupBy("shard").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        seekers = materialize(seekers, "ann-seekers")
        blocks = sized_broadcast(materialize(size(members, MEMBERS, "ms").join(size(seekers, QUERIES, "qs"), "shard"), "ann-blocks"))

        def dealt(df: DataFrame, own: str, others: str) -> DataFrame:
            part = F.pmod(F.xxhash64("e"), F.col(own)).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
            return df.join(blocks, "shard").select(*df.columns, part.alias(own[0]), every.alias(others[0])).groupBy("shard", "m", "q")

        return dealt(members, "ms", "qs").cogroup(dealt(seekers, "qs", "ms")).applyInArrow(_scorer(dim, k + 1), f"q {kind}, e {kind}, score double")

    start = materialize(search(_shards(forest, queries.select("e", "v", nothing), kind, vector, dim, first)), "ann-first")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # FIRST leaves hold some hundred entries, of which a row is the k + 1 best of a block.
    reached = start.groupBy("q").agg(F.get(F.sort_array(F.collect_set(F.struct("score", "e")), asc=False), k)["score"].alias("kth"))
    far = F.lit(2 * norm) * (F.lit(norm) - F.col("kth") / F.sqrt(square))
    limit = F.coalesce(F.greatest(far, F.lit(0.0)) * F.lit(slack / (dim + 1)), F.lit(math.inf))
    going = queries.join(reached, F.col("e") == F.col("q"), "left").select("e", "v", F.coalesce("kth", F.lit(-math.inf)).alias("has"), limit.alias("far"))
    found = start.unionByName(search(_shards(forest, going, kind, vector, dim, others)))
    found = found.groupBy("q", "e").agg(F.max("score").alias("score"))

    best = lambda who: F.row_number().over(Window.partitionBy(who).orderBy(F.desc("score"), "e"))
    top = found.withColumn("place", best("q")).where(F.col("place") <= k + 1).select("q", "e", "score")
    ids = top.join(entries.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("e"))
    ids = ids.withColumn("place", best("q")).where(F.col("place") <= k + 1)
    lists = materialize(ids.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "e", "score"))).alias("list")), "ann-found")
    near = F.slice(F.filter("list", lambda x: x["e"] != F.col("id")), 1, k)
    out = asked.join(sized_broadcast(lists, 50_000), F.col("e") == F.col("q")).select(F.col("id").alias("query_id"), F.posexplode(near).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.e").alias(id_col), F.col("x.score").alias("score"))
