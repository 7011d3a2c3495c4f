import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import bpe, token_counts
from millrace.llm import queries as Q

from .helpers import AWKWARD, docs, sha

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "  a  b   c ", " x\n y", "a\x1c b \x1c\x1cc", "　  x  y", "it's  I'LL 's", "\0\0 a", "\U0001f600 é" * 3,
    " " * 5000, "a" * 3000, "a \n\n b\n \nc", "x\t y\t\tz", "²³ ⅷ½ a_b", "<|endoftext|> a<|endoftext|>", "a b   c\x85 d", "q" * 30_000 + " ,.;" * 99,
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_matches_the_library(reference, monkeypatch):
    codec = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)
    for _ in range(2):
        got = codec.encode_all(ODD)
        assert got.to_pylist() == [reference.encode_ordinary(t) for t in ODD]
        assert codec.decode_all(got).to_pylist() == [t.encode() for t in ODD]
        monkeypatch.setattr(bpe, "MEMO", 3)  # nearly everything is forgotten and learned again
    import pyarrow as pa

    assert codec.decode_all(pa.array([[1], None, []], pa.list_(pa.int32()))).to_pylist() == [codec_token(1), None, b""]
    for bad in (-1, 60_000):
        with pytest.raises(ValueError):
            codec.decode_all(pa.array([[bad]], pa.list_(pa.int32())))


def test_chunks_keep_what_is_used_most(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 40)
    codec, learned = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN), []
    learn = codec.chunks.learn
    codec.chunks.learn = lambda new: (learned.extend(new), learn(new))
    for no in range(30):
        texts = [f"the often seen words {no} and rare{no}word, {no}-th 'é{no}ü' of", "the often\n\nseen  words ", ""]
        got = codec.encode_all(texts)
        assert got.to_pylist() == [reference.encode_ordinary(t) for t in texts]
        assert codec.decode_all(got).to_pylist() == [t.encode() for t in texts]
    assert learned.count(" often") == 1 and len(learned) > 100
    assert len(codec.chunks.first) + len(codec.chunks.later) == len(codec.chunks.uses) == len(codec.sizes) <= 50


def codec_token(rank):
    return {r: t for t, r in bpe.read_ranks(RANKS).items()}[rank]


def test_ranks_must_hold_every_byte():
    with pytest.raises(ValueError):
        bpe.sentencepiece_model({b"a": 0})


def test_byte_bpe_query_matches_the_library(spark, sf, reference):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op7_byte_bpe(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ids = reference.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text[r.doc_id]))


def test_byte_bpe_awkward(spark, reference):
    frame = docs(spark, AWKWARD)
    coded = bpe.bpe_decode(bpe.bpe_encode(frame, RANKS, P.PATTERN), RANKS).collect()
    both = bpe.bpe_round_trip(frame, RANKS, P.PATTERN).collect()
    assert coded == both and len(both) == len(AWKWARD)
    for r in both:
        assert r.token_ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r["size"] == "mine"
    assert bpe.bpe_round_trip(docs(spark, []), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_match_the_library(name):
    data = open(P.path(name), "rb").read()
    counter = token_counts.Counter(data, "." + name.split(".")[1])
    assert counter.by_chunk == (name == "byte_bpe_50k.json")
    if name.endswith(".json"):
        tok = Tokenizer.from_file(P.path(name))
        want = [len(tok.encode(t, add_special_tokens=False).ids) for t in ODD]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(ODD, num_threads=1)]
    assert np.array_equal(counter(ODD), want) and np.array_equal(counter(ODD), want)


def test_token_counts_query_matches_the_library(spark, sf):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op9_token_counts(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        n = len(tok.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 512)


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_token_cache_encodes_distinct_misses_only(spark, tmp_path, limit, monkeypatch):
    cache, path = f"file://{tmp_path}/cache-{limit}", P.path("byte_bpe_50k.json")
    first = token_counts.count_tokens(docs(spark, AWKWARD[:6]), path, cache, broadcast_rows=limit)
    assert first.count() == 6
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in AWKWARD[:6]})
    got = token_counts.count_tokens(docs(spark, AWKWARD), path, cache, broadcast_rows=limit).collect()
    assert len(got) == len(AWKWARD)
    tok = Tokenizer.from_file(path)
    want = {hashlib.sha256((t or "").encode()).digest(): len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in AWKWARD}
    assert all(r.n_tokens == want[bytes(r.digest)] for r in got)
    after = spark.read.parquet(cache)
    assert after.select("digest").distinct().count() == len(want)
    assert after.count() <= len(want) + 1  # rows that repeat id and text stand for each other
    other = token_counts.count_tokens(docs(spark, AWKWARD), P.path("piece_bpe_32k.model"), cache, broadcast_rows=limit)
    assert other.count() == len(AWKWARD) and spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_counts.count_tokens(docs(spark, []), path, cache).count() == 0
