import random
from collections import Counter

import pytest
import xxhash

from millrace.llm import components, shared, simhash
from millrace.llm import queries as Q

from .helpers import AWKWARD, LONG, docs


def brute_fingerprint(text, k=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, near):
    """items: (id, value); value -> smallest id reachable."""
    values = sorted({v for _, v in items})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                parent[find(a)] = find(b)
    low = {}
    for i, v in items:
        r = find(v)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return {v: low[find(v)] for v in values}


def close(a, b):
    return (a ^ b).bit_count() <= 4


def test_simhash_matches_brute_force(spark, sf):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    low = brute_components(rows, close)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op2_simhash_dedup(spark, sf).collect()}
    assert got == {i: (f"{v:016x}", low[v]) for i, v in rows}


def test_simhash_awkward(spark):
    found = simhash.simhash_dedup(docs(spark, AWKWARD)).collect()
    rows = [(r[0], brute_fingerprint(r[1])) for r in AWKWARD]
    low = brute_components(rows, close)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == Counter((i, v, low[v]) for i, v in rows)
    assert simhash.simhash_dedup(docs(spark, [])).count() == 0
    kept = simhash.keep_one(docs(spark, AWKWARD)).collect()
    assert len(kept) == len(set(low.values()) - {None}) + sum(v is None for v in {brute: low[brute] for _, brute in rows}.values())
    assert Counter(r.doc_id for r in kept) == Counter(low[v] for v in low if low[v] is not None and dict(rows)[low[v]] == v) + Counter(None for v in low if low[v] is None)


def test_keep_one_of_rows_that_repeat(spark):
    rows = [(4, "a b c d e f", i) for i in range(40)] + [(7, "a b c d e f", 0), (2, "other words stand here", 0)] + [(None, "none has an id", i) for i in range(30)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, no int").repartition(7))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(4, "a b c d e f"): 1, (2, "other words stand here"): 1, (None, "none has an id"): 1}
    assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_a_large_near_group(spark):
    """Many fingerprints around one, a chain, and strangers; small parts force the pairs of parts."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    near = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    chain, x = [], rng.getrandbits(64)
    for _ in range(60):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        chain.append(x)
    values = sorted({*near, *chain, *(rng.getrandbits(64) for _ in range(300))})
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for part in (16, 2048):
        links = simhash.simhash_links(frame, part=part)
        root = {r.node % 2**64: r.root for r in components.connected_components(links).collect()}
        low = brute_components([(v, v) for v in values], close)
        groups, want = {}, {}
        for v in values:
            groups.setdefault(root.get(v, v if v < 2**63 else v - 2**64), set()).add(v)
            want.setdefault(low[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_every_pair_within_the_bits_shares_a_key():
    rng, keys = random.Random(1), simhash.block_keys(4, 6)
    assert len(keys) == 15
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & int(k) == b & int(k) for k in keys)


@pytest.mark.parametrize(("shape", "chunk"), [("chain", 1), ("star", 1_000), ("star", 20), ("none", 3)])
def test_components(spark, shape, chunk, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK", chunk)
    n = 400
    order = list(range(n))
    random.Random(3).shuffle(order)
    pairs = {"chain": list(zip(order, order[1:])), "star": [(order[0], v) for v in order[1:]], "none": []}[shape]
    rows = [*pairs, (5, 5), (None, 3), (n + 7, n + 9), (n + 9, n + 8)]
    frame = spark.createDataFrame(rows, "u long, v long").repartition(7)
    want = {**({v: 0 for v in range(1, n)} if pairs else {}), n + 8: n + 7, n + 9: n + 7}
    assert {r.node: r.root for r in components.connected_components(frame).collect()} == want


def test_long_text_is_read_whole():
    assert simhash.fingerprint(LONG) == brute_fingerprint(LONG)
    assert simhash.fingerprint(LONG + " " + LONG[::-1] * 2) == brute_fingerprint(LONG + " " + LONG[::-1] * 2)
