"""Cross-tokenizer alignment by byte-owner arrays: which tokens of two vocabularies cover the same bytes."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import _OPENING_SPACE, cut, gather
from millrace.llm.shared import bound_batches, free_name, join_sized, lean_worker, materialize, settled

#: Distinct chunks of text that a worker remembers, about 300 bytes each.
MEMO = 300_000
#: Pairs of ids whose table is broadcast; beyond it the links of documents meet it by pair.
PAIRS = 2_000_000
#: Texts that a worker takes at a time.
TEXTS = 64
ALIGNED = {
    "n_a": T.LongType(),
    "n_b": T.LongType(),
    "n_groups": T.LongType(),
    "groups": T.StringType(),
    "links": T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.IntegerType())])),
}


def byte_of_character() -> dict[str, int]:
    """The map of byte-level vocabularies from characters to bytes: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers, and the alignment of chunks seen before.

    A is a byte-level vocabulary of the tokenizers library, which encodes a space and the text; B is a sentencepiece
    model, which adds that space. Both open a token at a space between two non-space characters: A by its pattern, B if
    no piece has a space after another character. Then what holds for the chunks between such spaces holds for the
    text, and a chunk is encoded and aligned once. Otherwise a text is one chunk.
    """

    def __init__(self, json_data: bytes, model: bytes) -> None:
        spec = json.loads(json_data)
        self.a = tokenizers.Tokenizer.from_str(json_data.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        known, space = byte_of_character(), "▁"
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        added = {t["id"] for t in spec.get("added_tokens", [])}
        plain = lambda i, t: t.encode() if i in added or any(c not in known for c in t) else bytes(known[c] for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        a_bytes = [plain(i, entries[i]) if i in entries else b"" for i in range(max(entries) + 1)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(space, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(pieces)]
        self.tables = [_table(xs) for xs in (a_bytes, b_bytes)]
        self.names = [pa.array([str(i) for i in range(len(xs))]) for xs in (a_bytes, b_bytes)]
        pre = spec.get("pre_tokenizer") or {}
        apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("post_processor")
        self.by_chunk = bool(apart) and not any(x != space and y == space for p in pieces for x, y in zip(p, p[1:]))
        self.row: dict[str, int] = {}
        #: of every chunk its groups as text; how often it was used, whether its bytes came back, and n_a, n_b and n_groups; its links.
        self.told: list[str] = []
        self.uses, self.good, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros((0, 3), dtype=np.int64)
        self.starts, self.counts, self.pairs = array("q"), array("q"), array("q")

    def _parts(self, text: str) -> list[str]:
        if not self.by_chunk or not text:
            return [text]
        return _OPENING_SPACE.split(text) if text[0] == " " else cut(text)

    def _learn(self, new: list[str]) -> None:
        """Encodes and aligns new chunks, all at once."""
        coded = [x.ids for x in self.a.encode_batch_fast([" " + c for c in new], add_special_tokens=False)], self.b.encode(new, num_threads=1)
        want = [(" " + c).encode("utf-8", "surrogatepass") for c in new]
        length = np.fromiter(map(len, want), dtype=np.int64, count=len(new))
        good = np.fromiter(map(bool, new), dtype=bool, count=len(new))
        ids, of = [], []
        for lists, (start, size, _) in zip(coded, self.tables):
            counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(new))
            ids.append(np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum())))
            of.append(np.repeat(np.arange(len(new)), counts))
            good &= np.bincount(of[-1], weights=size[ids[-1]], minlength=len(new)).astype(np.int64) == length
        for k, (start, size, data) in enumerate(self.tables):
            told = np.frombuffer(b"".join([w for w, g in zip(want, good) if g]), dtype=np.uint8)
            own = ids[k][good[of[k]]]
            wrong = np.flatnonzero(gather(own, start, size, data)[0] != told)
            good[np.unique(np.repeat(np.flatnonzero(good), length[good])[wrong])] = False
        (a, of_a), (b, of_b) = ((x[good[o]], o[good[o]]) for x, o in zip(ids, of))
        # The owner of a byte is the token that covers it. Two owners that stand together are a link, and where both
        # change a group ends; the ends of chunks are such places.
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.tables[0][1][a]), np.repeat(np.arange(len(b)), self.tables[1][1][b])
        turn_a, turn_b = (np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, dtype=bool) for x in (owner_a, owner_b))
        heads, cuts = np.flatnonzero(turn_a | turn_b), np.flatnonzero(turn_a & turn_b)
        of_group = of_a[owner_a[cuts]]
        n_groups, links = (np.bincount(x, minlength=len(new)) for x in (of_group, of_a[owner_a[heads]]))
        sides = [_joined(names.take(pa.array(x)), np.r_[first, len(x)], ",") for names, x, first in zip(self.names, (a, b), (owner_a[cuts], owner_b[cuts]))]
        groups = pc.binary_join_element_wise(*sides, "|")
        self.told += _joined(groups, np.r_[0, np.cumsum(n_groups)], ";").to_pylist()
        self.row.update(zip(new, range(len(self.uses), len(self.uses) + len(new))))
        self.uses = np.r_[self.uses, np.zeros(len(new), dtype=np.int64)]
        self.good = np.r_[self.good, good]
        self.sizes = np.concatenate([self.sizes, np.column_stack([np.bincount(of_a, minlength=len(new)), np.bincount(of_b, minlength=len(new)), n_groups])])
        self.starts.frombytes((len(self.pairs) + np.cumsum(links) - links).astype(np.int64).tobytes())
        self.counts.frombytes(links.astype(np.int64).tobytes())
        self.pairs.frombytes(pair_of(a[owner_a[heads]], b[owner_b[heads]]).tobytes())

    def _links(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(rows, *(np.frombuffer(x, dtype=np.int64) if len(x) else np.zeros(0, np.int64) for x in (self.starts, self.counts, self.pairs)))

    def _shrink(self) -> None:
        """Keeps the half of the chunks that was used most."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: MEMO // 2])
        place = np.full(len(self.uses), -1, dtype=np.int64)
        place[kept] = np.arange(len(kept))
        at = place.tolist()
        self.row = {c: at[r] for c, r in self.row.items() if at[r] >= 0}
        self.told = [self.told[k] for k in kept.tolist()]
        self.uses, self.good, self.sizes = self.uses[kept] // 2, self.good[kept], self.sizes[kept]
        pairs, ends = self._links(kept)
        self.starts, self.counts, self.pairs = array("q", ends[:-1].tobytes()), array("q", np.diff(ends).tobytes()), array("q", pairs.tobytes())

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        """The columns ``ALIGNED`` of texts."""
        if len(self.uses) > MEMO:
            self._shrink()
        parts = [self._parts(t or "") for t in texts]
        known = self.row.get
        found = [list(map(known, p)) for p in parts]
        if gaps := [i for i, f in enumerate(found) if None in f]:
            self._learn(list(dict.fromkeys(c for i in gaps for c, r in zip(parts[i], found[i]) if r is None)))
            for i in gaps:
                found[i] = list(map(self.row.__getitem__, parts[i]))
        begin = np.r_[0, np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))]
        rows = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(begin[-1]))
        whole = np.logical_and.reduceat(self.good[rows], begin[:-1])  # a text has a chunk at least
        found = [f if w else [] for f, w in zip(found, whole.tolist())]
        rows = rows[np.repeat(whole, np.diff(begin))]
        begin = np.r_[0, np.cumsum(np.diff(begin) * whole)]
        self.uses += np.bincount(rows, minlength=len(self.uses))
        sizes = np.diff(np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.sizes[rows], axis=0)])[begin], axis=0)
        pair, upto = self._links(rows)
        upto = upto[begin]
        own = [np.unique(pair[x:y], return_counts=True) for x, y in zip(upto.tolist(), upto[1:].tolist())]
        values = [pa.array(np.concatenate([np.zeros(0, np.int64), *(o[i] for o in own)]), kind) for i, kind in ((0, pa.int64()), (1, pa.int32()))]
        links = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(o[0]) for o in own])], pa.int32()), pa.StructArray.from_arrays(values, names=["pair", "n"]))
        told = pa.array([";".join(map(self.told.__getitem__, f)) for f in found], pa.string())
        return [*(pa.array(np.ascontiguousarray(sizes[:, k])) for k in range(3)), told, links]


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the bytes of each token begin, how many they are, and all bytes."""
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(tokens), dtype=np.uint8)


def _joined(strings: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """Stretches of strings, each joined to one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), mark)


def pair_of(a, b):
    """One number for an id of A and one of B; ``b_of`` has the latter back."""
    return a << 32 | b


def b_of(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit((1 << 32) - 1))


def a_of(pair: Column) -> Column:
    return F.shiftright(pair, 32)


@lru_cache(maxsize=1)
def _pair(json_data: bytes, model: bytes) -> Pair:
    lean_worker()
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its own
    return Pair(json_data, model)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align_tokens(docs: DataFrame, byte_level: str, piece_model: str, text_col: str = "text", rows: int = TEXTS) -> DataFrame:
    """Adds the alignment of every whole text's tokens in two vocabularies, without special tokens.

    ``n_a``, ``n_b``: its tokens. ``groups``: the ids of both as text, ``a1,a2|b1;a3|b2,b3``, cut wherever a token of A and
    one of B end at the same byte (``group_arrays`` has them as arrays); ``n_groups`` counts them. ``links`` array<struct<pair, n>>: the
    pairs of ids (``a_of``, ``b_of``) whose occurrences share a byte, and how many such occurrences there are. A is a file of
    the tokenizers library and encodes a space and the text, B a sentencepiece model that adds the space; special strings
    inside texts are plain text.

    Cases: a text that is null or empty, or whose bytes do not come back from the tokens of both (A's entries decoded,
    B's pieces with U+2581 as a space), has no tokens: zeros, '' and no links. Columns of the added names are replaced;
    other columns, repeated rows and empty tables pass as they are.
    """
    docs = docs.drop(*ALIGNED)
    bound_batches(docs.sparkSession)
    data, model, at = _read(byte_level), _read(piece_model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(data, model)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, *pair.align(batch.column(at).to_pylist())], names=[*batch.schema.names, *ALIGNED])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in ALIGNED.items())]))


def group_arrays(groups: Column) -> Column:
    """Groups as array<struct<a array<int>, b array<int>>>."""
    ids = lambda side: F.split(side, ",").cast("array<int>")
    each = lambda g: F.struct(ids(F.split_part(g, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(g, F.lit("|"), F.lit(2))).alias("b"))
    return F.when(groups == "", F.array().cast("array<struct<a: array<int>, b: array<int>>>")).otherwise(F.transform(F.split(groups, ";"), each))


def pair_counts(aligned: DataFrame, links: str = "links") -> DataFrame:
    """(pair, count, best, rows): of every pair of ids the links of the whole corpus, whether no other id of A has more
    links with that id of B, and the rows that hold the pair."""
    each = aligned.select(F.explode(links).alias("l")).select("l.pair", "l.n")
    counts = materialize(each.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("rows")), "align-counts")
    top = counts.groupBy(b_of(F.col("pair")).alias("b")).agg(F.max("count").alias("top"))
    return counts.join(top, b_of(F.col("pair")) == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"), "rows")


def score_links(aligned: DataFrame, pairs: int = PAIRS, links: str = "links") -> DataFrame:
    """Replaces the links of each row by ``n_links``, ``n_best`` (links whose pair is the best of its id of B, ties
    included) and ``count_sum`` (the corpus-wide counts of its links, summed).

    The frame is written first; rows go by their number there, so repeated rows are told apart. The table of pairs is
    broadcast if it has ``pairs`` rows at most; otherwise links meet it by pair, frequent pairs dealt out.

    Cases: rows without links have zeros; columns with the added names are replaced; an empty table gives an empty result.
    """
    spark, added = aligned.sparkSession, ("n_links", "n_best", "count_sum")
    aligned = aligned.drop(*added)
    number = free_name(aligned, "row_no")

    def build() -> DataFrame:
        rows = materialize(aligned.withColumn(number, F.monotonically_increasing_id()), "align-rows")
        counts = materialize(pair_counts(rows, links), "align-pairs")
        each = rows.select(F.col(number).alias("no"), F.explode(links).alias("l")).select("no", "l.pair", "l.n")
        if counts.limit(pairs + 1).count() <= pairs:
            met = each.join(F.broadcast(counts.drop("rows")), "pair")
        else:
            met = join_sized(each, counts, "pair", size="rows", deal=F.col("no"))
        sums = F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
        scored = met.groupBy(F.col("no").alias(number)).agg(*sums)
        out = rows.drop(links).join(scored, number, "left").drop(number)
        return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in added})

    return settled(spark, "align-scored", build)
