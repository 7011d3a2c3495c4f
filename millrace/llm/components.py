"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import discard, join_sized, materialize

MAX_ROUNDS = 60


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each batch of edges by stars (node, smallest node of its component within the batch)."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(a):
            continue
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (u long, v long) to (node, root): root is the smallest node reachable; nodes without edges are absent.

    Every task first contracts its own edges to stars. Then large-star and small-star rounds (Kiveris et al., 2014)
    alternate until nothing changes: each links a node's neighbours to its smallest neighbour, so long chains shrink
    geometrically. Minima are pre-aggregated before the exchange, and the edges of a node of many are dealt out when
    they meet its minimum. Every round is written to the shared folder and the one before it deleted. Null endpoints and self loops are ignored; no edges give no rows.
    """
    known = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    stars = materialize(known.mapInArrow(_contract, "u long, v long").distinct(), "components")
    mark = None
    for _ in range(MAX_ROUNDS):
        stars, before = _round(stars), stars
        discard(before)
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == mark or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _round(stars: DataFrame) -> DataFrame:
    both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    large = join_sized(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    large = materialize(large, "components")
    lowest = _lowest(large)
    to_low = join_sized(large, lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(to_low.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "components")
    for done in (low, large, lowest):
        discard(done)
    return out


def _lowest(edges: DataFrame) -> DataFrame:
    """Of every u its smallest neighbour m and the number of its edges."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "components")
