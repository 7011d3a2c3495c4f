"""SimHash near-dedup with pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.shared import bound_batches, free_name, join_sized, lean_worker, materialize, settled, sized_broadcast

#: Shingles hashed at a time; bounds the memory that a long text takes.
CHUNK = 1 << 16
#: Fingerprints of one key that a task compares at a time. Larger keys are dealt out as pairs of parts.
PART = 8192


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of a whole text over word shingles; a bit is set if it is in over half of the shingles' XXH64.

    bytes.lower() changes A-Z only and bytes.split() cuts at the six ASCII spaces only. No words: 0.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    last = max(1, len(w) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, last, CHUNK):
        part = w[at : min(at + CHUNK, last) + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        digests = b"".join([xxhash.xxh64_digest(s, 42) for s in shingles])
        ones += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > last).tobytes(), "big")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def block_keys(bits: int, blocks: int) -> list[np.ndarray]:
    """Masks of ``blocks - bits`` of the blocks: fingerprints within ``bits`` differing bits agree under one at least."""
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
    one = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:])]
    return [np.uint64(sum(c)) for c in combinations(one, blocks - bits)]


def _forest(group: np.ndarray, bits: int, out: list[np.ndarray]) -> None:
    """Edges of a spanning forest of the links among a key's fingerprints; each is compared until it is reached."""
    left = group
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            f = queue.pop()
            near = _distance(left, f) <= bits
            if near.any():
                found, left = left[near], left[~near]
                out.append(np.stack([np.full(len(found), f, dtype=np.uint64), found]))
                queue.extend(found)


def _links(bits: int):
    """From rows sorted by (key, tile) to links between fingerprints; a run is the rows of one key and tile."""

    def solve(run_of: np.ndarray, fp: np.ndarray) -> np.ndarray:
        out: list[np.ndarray] = []
        starts = np.flatnonzero(np.r_[True, run_of[1:] != run_of[:-1]])
        sizes = np.diff(np.r_[starts, len(fp)])
        for at, n in zip(starts[sizes > 32], sizes[sizes > 32]):
            _forest(np.unique(fp[at : at + n]), bits, out)
        small = np.repeat(sizes <= 32, sizes)
        run, f = run_of[small], fp[small]
        for d in range(1, int(sizes[sizes <= 32].max(initial=1))):
            same = run[d:] == run[:-d]
            a, b = f[:-d][same], f[d:][same]
            near = (_distance(a, b) <= bits) & (a != b)
            out.append(np.stack([a[near], b[near]]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []

        def emit(parts: list[tuple]) -> pa.RecordBatch:
            key, tile, fp = (np.concatenate(c) for c in zip(*parts))
            run_of = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            a, b = solve(run_of, fp.view(np.uint64)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile, fp = (np.asarray(batch.column(i)) for i in range(3))
            cut = int(np.flatnonzero((key != key[-1]) | (tile != tile[-1])).max(initial=-1)) + 1
            if cut:  # the last run may go on in the next batch
                yield emit([*rest, (key[:cut], tile[:cut], fp[:cut])])
                rest = []
            rest.append((key[cut:], tile[cut:], fp[cut:]))
        if rest:
            yield emit(rest)

    return run


def simhash_links(fingerprints: DataFrame, bits: int = 4, blocks: int = 6, part: int = PART) -> DataFrame:
    """From distinct fingerprints (fp long) to links (u, v) of a graph with the same components as all pairs within ``bits``.

    Every fingerprint goes to the C(blocks, bits) keys made of ``blocks - bits`` of its blocks. A key's rows are
    compared in one run and leave a spanning forest, fewer links than rows. Keys of more than ``part`` rows are cut
    into parts by hash and each pair of parts is a run of its own, so no task holds more than two parts of a key and
    no pair is lost; a key of n different fingerprints makes n * n / part rows.
    """
    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = F.array(*[F.lit(int(np.int64(m.view(np.int64)))) for m in block_keys(bits, blocks)])
    key = F.xxhash64("no", F.col("fp").bitwiseAND(F.col("mask")))
    keyed = fingerprints.select("fp").repartition(n, "fp").select("fp", F.posexplode(masks).alias("no", "mask"))
    keyed = materialize(keyed.select("fp", key.alias("key")), "simhash-keyed")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    hit = join_sized(keyed, materialize(sizes, "simhash-keys"), "key")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = hit.select("key", "fp", "parts", own.alias("own"), other.alias("other"))
    tile = (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).cast("int")
    runs = dealt.select("key", tile.alias("tile"), "fp").repartition(n, "key", "tile").sortWithinPartitions("key", "tile")
    return runs.mapInArrow(_links(bits), "u long, v long")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "tag", "fp"])

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """(id, tag, fp, root, component_id) of every row; tag is a hash of the text, root the component's smallest fp."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    prints = materialize(rows.mapInArrow(_fingerprints(words), f"id {kind}, tag long, fp long"), "simhash")

    def of_prints() -> DataFrame:
        nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows")), "simhash-nodes")
        roots = connected_components(simhash_links(nodes.select("fp"), bits))
        linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", "rows", F.coalesce("root", "fp").alias("root"))
        linked = materialize(linked, "simhash-linked")
        lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
        return join_sized(linked, materialize(lowest, "simhash-lowest"), "root")

    named = settled(docs.sparkSession, "simhash-named", of_prints)
    found = join_sized(prints, named.select("fp", "root", "component_id", F.col("rows").alias("n")), "fp")
    return found.select("id", "tag", "fp", "root", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row a document: (``id_col``, ``fp`` long, ``component_id``), the smallest id reachable over links.

    Fingerprints within ``bits`` differing bits link, equal ones included. Equal fingerprints are one node of the
    graph, so copies cost nothing beyond their own row.

    Cases: null and wordless texts have fingerprint 0 and link like any other; texts below ``words`` words have one
    shingle, the whole sequence. Rows with a null id get a component too; its id is null where no row of it has one.
    Repeated rows are returned as often as they come. An empty table gives an empty result. Other columns are ignored.
    """
    return _classes(docs, id_col, text_col, words, bits).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays (nulls last, then by
    text hash), and one of rows that repeat it.

    Only ids and hashes are grouped. The corpus itself meets the list of rows to leave out, which is broadcast if its
    counted rows are few; otherwise the texts are shuffled by id and text hash.

    Cases: null, empty and wordless texts are near copies of each other (fingerprint 0), so one of them stays. Very
    long texts are read whole. An empty table gives an empty result. The columns are those of the input, whatever
    their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = materialize(_classes(docs, id_col, text_col, words, bits).select("id", "tag", "root"), "simhash-classes")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")).alias("first"), F.count("*").alias("n"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tag") == F.col("first.tag"))
    gone = join_sized(found, materialize(first, "simhash-first"), "root").where(~same).select("id", "tag").distinct()
    twice = found.groupBy("id", "tag").count().where("count > 1").select("id", "tag")
    tag, key, other = (free_name(docs, n) for n in ("row_tag", "row_id", "other_tag"))
    tagged = docs.withColumn(tag, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))

    def meet(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = sized_broadcast(materialize(keys.select(F.col("id").cast(kind).alias(key), F.col("tag").alias(other)), "simhash-rows"))
        return left.join(keys, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(tag) == F.col(other)), how)

    stay = meet(tagged, gone, "left_anti")
    once = meet(stay, twice, "left_semi").dropDuplicates([id_col, tag])  # one a task before the exchange
    return meet(stay, twice, "left_anti").unionByName(once).select(docs.columns)
