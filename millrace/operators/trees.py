"""Decision trees over binned features, grown inside tasks: one subtree of few rows, or the histograms of a node of many.

Nodes are numbered level by level; the right child of a node follows its left one, and ``left`` of a leaf is -1. A row goes
left where its bin is not above the node's ``split``. Impurity is Gini's; all sums are integers, so their order does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Gains below this share of a node are rounding.
LEAST = 1e-12


@dataclass(frozen=True)
class Tree:
    """``feature``, ``split`` and ``left`` of each node; of leaves the counts (node, class, count), of features the gains times rows."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    cls: np.ndarray
    count: np.ndarray
    gains: np.ndarray


def bins_of(values: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """How many thresholds of its feature are below each value."""
    return np.stack([np.searchsorted(t, values[:, f]) for f, t in enumerate(thresholds)], axis=1).astype(np.uint8)


def drawn(rng: np.random.Generator, nodes: int, dim: int, tries: int) -> np.ndarray:
    """For each node ``tries`` different features (Floyd's sampling)."""
    out = np.empty((nodes, tries), np.int64)
    for j, most in enumerate(range(dim - tries, dim)):
        one = rng.integers(0, most + 1, nodes)
        out[:, j] = np.where((out[:, :j] == one[:, None]).any(axis=1), most, one)
    return out


def descend(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node, going = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(going := going[left[node[going]] >= 0]):
        at = node[going]
        node[going] = left[at] + (bins[going, feature[at]] > split[at])
    return node


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.diff(sorted_keys, prepend=-1))


def _best(b: np.ndarray, w: np.ndarray, pos: np.ndarray, key: np.ndarray, before: np.ndarray, total: np.ndarray, first: np.ndarray, n: np.ndarray, squares: np.ndarray) -> tuple:
    """Of one feature for each node: (nodes, score, last bin on the left). Rows stand by node and class.

    A side's score is its sum of squared class counts over its count; a row that changes sides changes the squares by what its class
    has before it, so classes need no columns of their own.
    """
    by_class = np.argsort(key * 256 + b)
    weight = w[by_class]
    ahead = np.cumsum(weight) - weight - before
    gained, lost = np.empty_like(w), np.empty_like(w)
    gained[by_class] = (2 * ahead + weight) * weight
    lost[by_class] = (2 * (total - ahead) - weight) * weight
    cells = pos * 256 + b
    by_bin = np.argsort(cells)
    cells = cells[by_bin]
    ends = np.flatnonzero(cells[1:] != cells[:-1])
    ends = ends[cells[ends] >> 8 == cells[ends + 1] >> 8]
    if not len(ends):
        return ends, np.zeros(0), ends
    at = cells[ends] >> 8

    def upto(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(x[by_bin])])
        return run[ends + 1] - run[first[at]]

    count = upto(w)
    score = upto(gained) / count + (squares[at] - upto(lost)) / (n[at] - count)
    begin = _starts(at)
    most = np.maximum.reduceat(score, begin)
    tops = np.flatnonzero(score == np.repeat(most, np.diff(begin, append=len(at))))
    tops = tops[_starts(at[tops])]
    return at[tops], score[tops], cells[ends[tops]] & 255


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tries: int, depth: int, rng: np.random.Generator) -> Tree:
    """The whole subtree over some rows, ``depth`` levels of splits at most."""
    dim, rows, pos, made = bins.shape[1], np.arange(len(bins)), np.zeros(len(bins), np.int64), 0
    y, w = y.astype(np.int64), w.astype(np.int64)
    nodes, leaves, gains, level = [], [], np.zeros(dim), 0
    while len(rows):
        order = np.argsort(pos * classes + y[rows])
        rows, pos = rows[order], pos[order]
        weight, key = w[rows], pos * classes + y[rows]
        first, group = _starts(pos), _starts(key)
        held, total = key[group], np.add.reduceat(weight, group)
        n = np.add.reduceat(weight, first)
        squares = np.add.reduceat(total * total, _starts(held // classes))
        k = len(n)
        best, feature, split = squares / n + LEAST * n, np.full(k, -1, np.int64), np.zeros(k, np.int64)
        if level < depth:
            # Nodes of one class are leaves; the others are numbered anew while their features are tried.
            mixed = np.flatnonzero(squares < n * n)
            inside = (squares < n * n)[pos]
            again = np.cumsum(squares < n * n) - 1
            r, p, mw = rows[inside], again[pos[inside]], weight[inside]
            if len(mixed):
                mkey = p * classes + y[r]
                mgroup, mfirst = _starts(mkey), _starts(p)
                sizes = np.diff(mgroup, append=len(r))
                mtotal = np.add.reduceat(mw, mgroup)
                before, all_of = np.repeat(np.cumsum(mtotal) - mtotal, sizes), np.repeat(mtotal, sizes)
                tried = drawn(rng, len(mixed), dim, tries)
                for j in range(tries):
                    at, score, last = _best(bins[r, tried[p, j]].astype(np.int64), mw, p, mkey, before, all_of, mfirst, n[mixed], squares[mixed])
                    better = score > best[mixed[at]]
                    own = mixed[at[better]]
                    best[own], feature[own], split[own] = score[better], tried[at[better], j], last[better]
        parts = feature >= 0
        np.add.at(gains, feature[parts], best[parts] - squares[parts] / n[parts])
        left = np.where(parts, made + k + 2 * (np.cumsum(parts) - 1), -1)
        nodes.append((feature, split, left))
        ends = ~parts[held // classes]
        leaves.append((made + held[ends] // classes, held[ends] % classes, total[ends]))
        stay = parts[pos]
        rows, pos = rows[stay], pos[stay]
        pos = left[pos] - made - k + (bins[rows, feature[pos]] > split[pos])
        made, level = made + k, level + 1
    return Tree(*(np.concatenate(x) for x in zip(*nodes)), *(np.concatenate(x) for x in zip(*leaves)), gains)


def histogram(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tried: np.ndarray, width: int, classes: int) -> np.ndarray:
    """Counts by tried feature, bin and class."""
    cells = ((np.arange(len(tried)) * width + bins[:, tried]) * classes + y[:, None]).ravel()
    return np.bincount(cells, np.repeat(w, len(tried)), len(tried) * width * classes).astype(np.int64).reshape(len(tried), width, classes)


def best_of(counts: np.ndarray) -> tuple[int, int, float, np.ndarray, np.ndarray] | None:
    """From a histogram: (which feature, last bin on the left, gain times rows, counts on the left, counts on the right)."""
    whole = counts[0].sum(axis=0)
    to_left = counts.cumsum(axis=1)[:, :-1]
    to_right = whole - to_left
    n_left, n_right = to_left.sum(axis=2), to_right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (to_left**2).sum(axis=2) / n_left + (to_right**2).sum(axis=2) / n_right
    score[(n_left == 0) | (n_right == 0)] = -1
    if not score.size:
        return None
    j, b = np.unravel_index(int(score.argmax()), score.shape)
    n = int(whole.sum())
    gain = score[j, b] - (whole**2).sum() / n
    return (int(j), int(b), float(gain), to_left[j, b], to_right[j, b]) if gain > LEAST * n else None


def record(columns: Sequence[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def numbers(values: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The numbers of binary values, one after the other."""
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in values]) if len(values) else np.zeros(0, kind)


@dataclass
class Top:
    """The first nodes of a tree, those of too many rows for one task. ``ends`` has the counts of leaves among them."""

    feature: list[int] = field(default_factory=lambda: [-1])
    split: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    level: list[int] = field(default_factory=lambda: [0])
    ends: dict[int, list[int]] = field(default_factory=dict)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        return descend(bins, np.array(self.feature), np.array(self.split), np.array(self.left))


def pieces(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, where it is), keys ascending."""
    order = np.argsort(keys, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        if len(run):
            yield int(keys[run[0]]), run


def blocks_of(batches: Iterator[pa.RecordBatch], dim: int, kind: type) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(block, size, other, bins) of each block."""
    for batch in batches:
        for block, size, other, bins in zip(*[batch.column(i) for i in range(4)]):
            rows = size.as_py()
            yield block.as_py(), rows, np.frombuffer(other.as_buffer(), kind), np.frombuffer(bins.as_buffer(), np.uint8).reshape(rows, dim)


def weights(seed: int, tree: int, block: int, size: int) -> np.ndarray:
    """How often a tree has each row of a block: Poisson of mean 1, as in Spark's bootstrap."""
    return np.random.default_rng([seed, 0, tree, block]).poisson(1.0, size)


def tried(seed: int, tree: int, node: int, dim: int, tries: int) -> np.ndarray:
    return drawn(np.random.default_rng([seed, 1, tree, node]), 1, dim, tries)[0]


def impurity_of(counts: np.ndarray) -> np.ndarray:
    return 1 - ((counts / counts.sum(axis=-1, keepdims=True)) ** 2).sum(axis=-1)
