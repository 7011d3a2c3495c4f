"""Byte-level BPE through a sentencepiece model that is written directly from a rank file."""

from __future__ import annotations

import base64
import codecs
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import bound_batches, lean_worker

#: A space that can be told to open a token: non-space on both sides.
_OPENING_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACE_RUN = re.compile(r" \s")
#: Distinct chunks that a worker remembers.
MEMO = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: varint, 32-bit float or bytes."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def _mapped(data: bytes) -> str:
    """Bytes as characters from U+0100 on, so that a piece is a string without spaces whatever its bytes."""
    return codecs.charmap_decode(data, "strict", _SHIFT)[0]


def _bytes_of(piece: str) -> bytes:
    """The inverse of ``_mapped``."""
    return codecs.charmap_encode(piece, "strict", _BACK)[0]


_SHIFT = "".join(chr(0x100 + b) for b in range(256))
_BACK = codecs.charmap_build(_SHIFT)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model: the piece of rank r has score -r, so merges go by rank; text passes unchanged.

    Piece ids are positions in rank order; the unknown piece, which the 256 single bytes make unreachable, is last.
    """
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{len(missing)} single bytes have no rank")
    piece, score, kind = 1, 2, 3
    pieces = [_field(piece, _mapped(t).encode()) + _field(score, -float(r)) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(piece, b"<unk>") + _field(score, 0.0) + _field(kind, 2))
    trainer = _field(3, 2) + _field(40, len(pieces) - 1) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    identity = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


def cut(text: str) -> list[str]:
    """Parts of a text, cut at spaces between two non-space characters; a chunk is a part with the space before it.

    Such a space always opens a pre-token, so what holds for the chunks one by one holds for the text.
    """
    if text.endswith(" ") or _SPACE_RUN.search(text):
        return _OPENING_SPACE.split(text)
    return text.split(" ")


class Chunks:
    """Remembers a row number for every chunk seen; ``learn`` gets new chunks and must append a row for each.

    Beyond ``most`` chunks the half that was used most stays: ``keep`` gets the row numbers that stay, in their new order.
    """

    def __init__(self, learn: Callable[[list[str]], None], keep: Callable[[np.ndarray], None], most: int | None = None) -> None:
        self.learn, self.keep, self.most = learn, keep, most
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.uses = np.zeros(0, dtype=np.int64)

    def _shrink(self, most: int) -> None:
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:most])
        new = np.full(len(self.uses), -1, dtype=np.int64)
        new[kept] = np.arange(len(kept))
        at = new.tolist()
        self.first, self.later = ({c: at[r] for c, r in known.items() if at[r] >= 0} for known in (self.first, self.later))
        self.uses = self.uses[kept] // 2
        self.keep(kept)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all chunks of all texts, and where each text's begin, with the end last."""
        if len(self.uses) > (most := self.most or MEMO):
            self._shrink(most // 2)
        parts = [cut(t) for t in texts]
        known = self.later.get
        found = [[self.first.get(p[0]), *map(known, p[1:])] for p in parts]
        if gaps := [i for i, r in enumerate(found) if None in r]:
            heads = {parts[i][0] for i in gaps} - self.first.keys()
            tails = {p for i in gaps for p, r in zip(parts[i][1:], found[i][1:]) if r is None}
            new = [*heads, *(" " + p for p in tails)]
            at = len(self.uses)
            self.learn(new)
            self.uses = np.r_[self.uses, np.zeros(len(new), dtype=np.int64)]
            self.first.update(zip(heads, range(at, at + len(heads))))
            self.later.update(zip(tails, range(at + len(heads), at + len(new))))
            for i in gaps:
                found[i] = [self.first[parts[i][0]], *map(self.later.__getitem__, parts[i][1:])]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        rows = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum()))
        self.uses += np.bincount(rows, minlength=len(self.uses))
        return rows, np.r_[0, np.cumsum(sizes)]


def gather(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that the rows stand for, joined, and the running lengths with 0 first."""
    size = sizes[rows]
    ends = np.cumsum(size)
    at = np.repeat(starts[rows] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], np.r_[0, ends]


class Codec:
    """Encodes and decodes with one vocabulary.

    The pattern cuts chunks into pre-tokens. A pre-token that is in the vocabulary is its own id; others go through
    the sentencepiece model, which merges by rank as byte-pair encoding does. Ids of chunks seen before are looked up.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, order = ranks, sorted(ranks.items(), key=lambda x: x[1])
        self.id_of_piece = np.array([r for _, r in order], dtype=np.int32)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        # White space is the Unicode property, as in the library whose ids these are.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.chunks = Chunks(self._learn, self._keep)
        self.starts, self.sizes, self.flat = array("q"), array("q"), array("i")
        self.token_size = np.full(self.id_of_piece.max() + 1, -1, dtype=np.int64)
        decoded = [_bytes_of(p) for p in self.model.id_to_piece(list(range(len(order))))]
        self.token_size[self.id_of_piece] = list(map(len, decoded))
        self.token_start = np.cumsum(np.maximum(self.token_size, 0)) - np.maximum(self.token_size, 0)
        self.token_bytes = np.frombuffer(b"".join(decoded), dtype=np.uint8)

    def _views(self) -> list[np.ndarray]:
        return [np.frombuffer(a, dtype=t) if len(a) else np.zeros(0, t) for a, t in ((self.starts, np.int64), (self.sizes, np.int64), (self.flat, np.int32))]

    def _keep(self, rows: np.ndarray) -> None:
        starts, sizes, flat = self._views()
        ids, upto = gather(rows, starts, sizes, flat)
        self.starts, self.sizes, self.flat = array("q", upto[:-1].tobytes()), array("q", sizes[rows].tobytes()), array("i", ids.tobytes())

    def _learn(self, new: list[str]) -> None:
        parts: list[str] = []
        counts = np.empty(len(new) + 1, dtype=np.int64)
        counts[0] = 0
        for i, c in enumerate(new, 1):
            if c[1:].isalpha() and c[0] == " ":  # needs no pattern
                parts.append(c)
            else:
                parts += self.find(c)
            counts[i] = len(parts)
        data = [p.encode("utf-8", "surrogatepass") for p in parts]
        rank = self.ranks.get
        ids = np.fromiter([rank(d, -1) for d in data], dtype=np.int32, count=len(data))
        merged = np.flatnonzero(ids < 0)
        coded = self.model.encode([_mapped(data[i]) for i in merged.tolist()], num_threads=1) if len(merged) else []
        sizes = np.ones(len(data), dtype=np.int64)
        sizes[merged] = np.fromiter(map(len, coded), dtype=np.int64, count=len(merged))
        flat, whole = np.repeat(ids, sizes), np.repeat(ids >= 0, sizes)
        flat[~whole] = self.id_of_piece[np.fromiter(chain.from_iterable(coded), dtype=np.int64, count=int((~whole).sum()))]
        upto = np.r_[0, np.cumsum(sizes)][counts]
        self.starts.frombytes((upto[:-1] + len(self.flat)).tobytes())
        self.sizes.frombytes(np.diff(upto).tobytes())
        self.flat.frombytes(flat.tobytes())

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        rows, begin = self.chunks.rows(texts)
        ids, upto = gather(rows, *self._views())
        return pa.ListArray.from_arrays(pa.array(upto[begin], pa.int32()), pa.array(ids, pa.int32()))

    def decode_all(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of lists of ids; null gives null."""
        lists = ids.fill_null([]) if ids.null_count else ids
        values = np.asarray(lists.flatten()).astype(np.int64)
        if len(values) and (values.min() < 0 or values.max() >= len(self.token_size) or (self.token_size[values] < 0).any()):
            raise ValueError("an id is outside the vocabulary")
        data, upto = gather(values, self.token_start, self.token_size, self.token_bytes)
        counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        ends = upto[np.r_[0, np.cumsum(counts)]].astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.binary())) if ids.null_count else out


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    """ranks: lines of a rank file."""
    lean_worker()
    return Codec({base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, ranks.split(b"\n")))}, pattern)


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoder(data: bytes, pattern: str, at: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                ids = codec.encode_all([t or "" for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, IDS])

    return run


def _decoder(data: bytes, pattern: str, at: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, codec.decode_all(batch.column(at))], names=[*batch.schema.names, DECODED])

    return run


def _with(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*docs.schema.fields, *fields])


IDS, DECODED = "token_ids", "decoded"
_IDS_FIELD, _DECODED_FIELD = T.StructField(IDS, T.ArrayType(T.IntegerType())), T.StructField(DECODED, T.BinaryType())


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", rows: int = 64) -> DataFrame:
    """Adds ``token_ids``, the token ids of every whole text (array<int>), without special tokens.

    The vocabulary file is read once by the driver and travels with the tasks. Texts are handled ``rows`` at a time.
    Cases: null counts as empty and has no ids; a column of the added name is replaced; other columns, repeated rows
    and empty tables pass as they are. Runs of spaces and other odd texts go through the pattern as they stand.
    """
    docs = docs.drop(IDS)
    bound_batches(docs.sparkSession)
    run = _encoder(_vocabulary(vocabulary), pattern, docs.columns.index(text_col), rows)
    return docs.mapInArrow(run, _with(docs, _IDS_FIELD))


def bpe_decode(docs: DataFrame, vocabulary: str, ids_col: str = IDS, rows: int = 64) -> DataFrame:
    """Adds ``decoded``, the bytes that a column of ids stands for: the model's pieces, each mapped back to bytes.

    Cases: null gives null, no ids give no bytes, an id outside the vocabulary is an error; a column of the added name
    is replaced; other columns, repeated rows and empty tables pass as they are.
    """
    docs = docs.drop(DECODED)
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_decoder(_vocabulary(vocabulary), "", docs.columns.index(ids_col), rows), _with(docs, _DECODED_FIELD))


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", rows: int = 64) -> DataFrame:
    """Adds ``token_ids`` and, decoded from them, ``decoded``, in one pass through one Python worker.

    Cases are those of ``bpe_encode``; null texts decode to no bytes. Columns of both added names are replaced.
    """
    docs = docs.drop(IDS, DECODED)
    bound_batches(docs.sparkSession)
    data = _vocabulary(vocabulary)
    encode = _encoder(data, pattern, docs.columns.index(text_col), rows)
    decode = _decoder(data, pattern, len(docs.columns), rows)
    return docs.mapInArrow(lambda batches: decode(encode(batches)), _with(docs, _IDS_FIELD, _DECODED_FIELD))


def token_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes the texts: (id, n_tokens, ids_sha256, decoded_sha256), one row a document.

    Cases: null counts as empty, whose digests are those of nothing; rows that repeat, and rows without an id, have a
    row each; an empty table gives an empty result; other columns are ignored.
    """
    read = bpe_round_trip(docs.select(id_col, text_col), vocabulary, pattern, text_col)
    told = F.array_join(F.col(IDS).cast("array<string>"), ",")
    return read.select(
        id_col,
        F.size(IDS).cast("long").alias("n_tokens"),
        F.sha2(told, 256).alias("ids_sha256"),
        F.sha2(DECODED, 256).alias("decoded_sha256"),
    )
