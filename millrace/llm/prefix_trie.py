"""Conversation prefix trie: tries of subtrees in the tasks, under a spine of prefixes that too many conversations share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.mixing import word_count
from millrace.llm.shared import BROADCAST_ROWS, join_sized, materialize, settled

#: Turns of a subtree that one task builds, about: at most MOST, and a SHARES-th of all turns if that is fewer, but LEAST.
MOST, SHARES, LEAST = 200_000, 256, 1_000
#: Ids of a chunk are 2**CHUNK_BITS neighbours at most, because an id is that of one conversation.
CHUNK_BITS = 8
NOTHING = hashlib.sha256(b"").hexdigest()
_KEY = ["k1", "k2"]
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_KINDS = "conv_id {0}, depth long, parent_conv_id {0}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: (conv_id, turns array<struct<digest, words>>), in the order of the turns.

    A digest is 128 bits of SHA-256 over role and text; texts themselves are not shuffled. Null numbers come first;
    turns that share a number, or have none, go by digest. A conversation is one value and so is gathered in one task.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    row = F.struct(F.col(turn_col).alias("at"), digest.alias("digest"), word_count(F.col(text_col)).alias("words"))
    known = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), row.alias("turn"))
    listed = known.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of all conversations of a table of turns; see ``turn_digests`` and ``sequence_trie``.

    Cases: null roles and texts count as empty; turns without a conversation are left out; rows that repeat are turns of their own; an empty table gives no node; other columns are ignored.
    """
    return sequence_trie(turn_digests(turns, conv_col, turn_col, role_col, text_col))


def _prefix(depth: int | None = None) -> list[Column]:
    """A 128-bit key of the first turns of a sequence, or of all."""
    turns = F.col("digests") if depth is None else F.slice("digests", 1, depth)
    return [F.xxhash64(F.lit(seed), turns).alias(k) for seed, k in zip((1, 2), _KEY)]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks (k1, k2, chunk, first, n, ids, digests, words) sorted by key and chunk to a row a distinct sequence.

    The digest runs over the chunks as they come, so however many conversations a sequence has, one chunk is held.
    """
    key, row, told = None, None, hashlib.sha256()
    kinds = None

    def out(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_convs", "ends_sha256", "digests", "words"])

    for batch in batches:
        kinds = [batch.schema.field("first").type, pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        done = []
        k1, k2, first, n, ids, digests, words = (batch.column(c) for c in ("k1", "k2", "first", "n", "ids", "digests", "words"))
        for i, own in enumerate(zip(k1.to_pylist(), k2.to_pylist())):
            if own != key:
                if key is not None:
                    done.append((*row[:2], told.hexdigest(), *row[2:]))
                key, told = own, hashlib.sha256(ids[i].as_py().encode())
                row = [first[i].as_py(), n[i].as_py(), digests[i].as_py(), words[i].as_py()]
            else:
                told.update(b"," + ids[i].as_py().encode())
                row[1] += n[i].as_py()
        if done:
            yield out(done)
    if key is not None:
        yield out([(*row[:2], told.hexdigest(), *row[2:])])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(conv_id, n_convs, ends_sha256, digests, words), one row a distinct sequence: its smallest id, its conversations
    and the digest of their ids. Ids are joined in chunks of neighbours first, so no task gathers all of a sequence."""
    arrays = sequences.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    keyed = arrays.select(*_prefix(), F.shiftright("conv_id", CHUNK_BITS).alias("chunk"), "*")
    chunks = keyed.groupBy(*_KEY, "chunk").agg(
        F.min("conv_id").alias("first"),
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
        F.first("digests").alias("digests"),
        F.first("words").alias("words"),
    )
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = sequences.schema["conv_id"].dataType.simpleString()
    told = f"conv_id {kind}, n_convs long, ends_sha256 string, digests array<binary>, words array<long>"
    return chunks.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "chunk").mapInArrow(_fold, told)


def _trie(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtrees, each below the spine node that its rows name."""
    children: dict[tuple, int] = {}
    parent, depth, words, n_convs, conv, ends, top = [], [], [], [], [], [], []
    columns = (rows[c].tolist() for c in ("conv_id", "n_convs", "ends_sha256", "digests", "words", "base", "p1", "p2", "parent_conv_id"))
    for own, n, told, digests, sizes, base, p1, p2, above in zip(*columns):
        at: int | tuple = (base, p1, p2)
        for d in range(base, len(digests)):
            node = children.get((at, digests[d]))
            if node is None:
                node = children[at, digests[d]] = len(parent)
                parent.append(at)
                depth.append(d + 1)
                words.append(int(sizes[d]))
                n_convs.append(0)
                conv.append(own)
                ends.append(NOTHING)
                top.append(above)
            n_convs[node] += n
            conv[node] = min(conv[node], own)
            at = node
        ends[at] = told
    size = len(parent)
    kids, leaves, saved = [0] * size, [0] * size, [(n - 1) * w for n, w in zip(n_convs, words)]
    # A child is made after its parent, so this order has all children of a node before it.
    for i in range(size - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if isinstance(up := parent[i], int):
            kids[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    is_top = [not isinstance(p, int) for p in parent]
    spine = [p if t else (None, None, None) for p, t in zip(parent, is_top)]
    over = [top[i] if is_top[i] else conv[parent[i]] for i in range(size)]
    out = pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": over, "n_convs": n_convs, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})
    for k, name in enumerate(("base", "p1", "p2")):
        out[name] = pd.array([s[k] for s in spine], dtype="Int64")
    return out


def sequence_trie(sequences: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """All nodes of the prefix trie of (conv_id, turns array<struct<digest, words>>), whose ids are whole numbers, not null, once each.

    A node is a distinct prefix: (conv_id, the smallest that has it; depth; parent_conv_id, that of its parent, null at
    the root; n_convs; n_children; n_leaves below it; saved_tokens, the sum over its subtree of (n_convs - 1) * words of
    the last turn; ends_sha256, of the ids of conversations that end there). The root is the prefix of no turn; text and role of a
    node are those of turn ``depth`` of ``conv_id``.

    Equal sequences are one row first. Sequences are dealt out by a hash of their first turn, and each task builds the
    tries of its subtrees from dictionaries of pointers. A first turn with more turns below it than a task should hold
    is a node of the spine: its sequences are dealt out by their next turn, and so on, a round for each turn that so
    many sequences share. Nodes of the spine get their sums from the tops of the subtrees, level by level.

    Cases: a sequence without turns ends at the root; an empty table gives no node.
    """
    spark = sequences.sparkSession
    return settled(spark, "trie-nodes", lambda: _build(sequences, most, least))


def _build(sequences: DataFrame, most: int, least: int) -> DataFrame:
    spark = sequences.sparkSession
    kind = sequences.schema["conv_id"].dataType.simpleString()
    rows = materialize(distinct_sequences(sequences), "trie-sequences")
    turns = F.size("digests")
    total, n_all, lowest = rows.agg(F.sum(turns), F.sum("n_convs"), F.min("conv_id")).first()
    none = spark.createDataFrame([], _KINDS.format(kind))
    if not n_all:
        return none
    most = max(least, min(most, total // SHARES))

    no_parent, ended = F.lit(None).cast(kind), rows.where(turns == 0).select("ends_sha256").first()  # one distinct sequence at most has no turn
    root = spark.range(1).select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        F.lit(lowest).cast(kind).alias("conv_id"), no_parent.alias("parent_conv_id"), F.lit(n_all).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"),
        F.lit(ended.ends_sha256 if ended else NOTHING).alias("ends_sha256"),
    )
    keep = ["conv_id", "n_convs", "ends_sha256", "digests", "words"]
    above = [F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(lowest).cast(kind).alias("parent_conv_id")]
    going = rows.where(turns > 0).select(*keep, *above)
    spine = [materialize(root, "trie-root")]
    closed = []
    while True:
        level = len(spine)
        keyed = going.select(*_prefix(level), "*")
        own = F.struct("p1", "p2", "parent_conv_id", F.element_at("words", level).alias("words"))
        sums = F.sum(turns - level + 1).alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.sum("n_convs").alias("convs"), F.first(own).alias("own")
        large = materialize(keyed.groupBy(*_KEY).agg(*sums).where((F.col("turns") > most) & (F.col("n") > 1)), "trie-large")
        many = large.limit(BROADCAST_ROWS + 1).count()
        if not many:
            closed.append(keyed.withColumn("base", F.lit(level - 1).cast("long")))
            break
        known = large.select(*_KEY, "n", "low")
        # A prefix is in this table only if it holds more than ``most`` turns, so there are SHARES of them in all but very large tables.
        met = keyed.join(F.broadcast(known.drop("n")), _KEY, "left") if many <= BROADCAST_ROWS else join_sized(keyed, known, tuple(_KEY), how="left", deal=F.xxhash64("conv_id"))
        met = materialize(met, "trie-open")
        closed.append(met.where("low is null").drop("low").withColumn("base", F.lit(level - 1).cast("long")))
        node = large.select(*_KEY, "own.p1", "own.p2", F.col("low").alias("conv_id"), "own.parent_conv_id", F.col("convs").alias("n_convs"), "own.words")
        spine.append(_with_ends(node, met.where("low is not null").where(turns == level).select(*_KEY, "ends_sha256")))
        going = met.where("low is not null").where(turns > level).select(*keep, F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("low").alias("parent_conv_id"))

    every = closed[0]
    for more in closed[1:]:
        every = every.unionByName(more)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // most) + 1)
    dealt = every.withColumn("bucket", F.pmod(F.xxhash64("base", *_KEY), F.lit(n)).cast("int")).drop(*_KEY)
    told = _KINDS.format(kind) + ", base long, p1 long, p2 long"
    built = materialize(dealt.repartition(n, "bucket").groupBy("bucket").applyInPandas(_trie, told), "trie-subtrees")

    tops = ["base", "p1", "p2"]
    below = F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")
    tops = materialize(built.where("base is not null").groupBy(*tops).agg(*below), "trie-tops")
    nodes, upper = built.select(*_NODE), None
    for level in range(len(spine) - 1, -1, -1):
        own = tops.where(F.col("base") == level).drop("base")
        if upper is not None:
            more = upper.groupBy("p1", "p2").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            own = own.unionByName(more).groupBy("p1", "p2").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])
        own = own.withColumnsRenamed({"p1": "k1", "p2": "k2"})
        upper = materialize(
            spine[level].join(own, _KEY, "left").select(
                "p1", "p2", "conv_id", F.lit(level).cast("long").alias("depth"), "parent_conv_id", "n_convs",
                F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
                (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), "ends_sha256",
            ),
            "trie-spine",
        )
        nodes = nodes.unionByName(upper.select(*_NODE))
    return nodes


def _with_ends(nodes: DataFrame, ended: DataFrame) -> DataFrame:
    """Adds the ids that end at nodes of the spine; one distinct sequence at most ends at each."""
    return nodes.join(ended, _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
