import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format, exact_dedup, mixing, shared
from millrace.llm import queries as Q

from ..oracle import compare
from .helpers import AWKWARD, docs, sha


def brute_exact(rows):
    best, size = {}, Counter()
    for i, t in rows:
        t = t or ""
        size[t] += 1
        if t not in best or (i is not None and (best[t] is None or i > best[t])):
            best[t] = i
    return best, size


def test_exact_dedup_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    best, size = brute_exact(rows)
    text = dict(rows)
    got = Q.op1_exact_dedup(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        t = text[r.doc_id] or ""
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best[t], size[t], best[t] == r.doc_id, sha(t))


@pytest.mark.parametrize("limit", [1_000, 0])
def test_exact_dedup_awkward(spark, limit):
    got = exact_dedup.exact_dedup(docs(spark, AWKWARD), broadcast_rows=limit).collect()
    best, size = brute_exact([(r[0], r[1]) for r in AWKWARD])
    assert len(got) == len(AWKWARD)
    assert Counter(r.text or "" for r in got if r.kept) == Counter(best.keys())
    for r in got:
        assert r.keep_id == best[r.text or ""] and r.group_size == size[r.text or ""]
        assert not r.kept or r.doc_id == r.keep_id
        assert r["size"] == "mine"
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_same_length_and_prefix(spark):
    a, b = "x" * 300 + "a", "x" * 300 + "b"
    got = exact_dedup.exact_dedup(docs(spark, [(1, a, "s", "en"), (2, b, "s", "en"), (3, a, "s", "en")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 3, False), (2, 2, True), (3, 3, True)}


def test_each_step_passes_on_fewer_rows(spark):
    """Lengths prune before prefixes are read, and prefixes before whole texts are hashed."""
    a = "x" * 300
    rows = [(1, "p"), (2, "qq"), (3, a + "a"), (4, a + "b"), (5, "y" + a), (6, a + "a"), (7, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.len for r in exact_dedup.shared_lengths(frame).collect()) == [0, 301]
    of = {i: (len(t or ""), (t or "")[:256]) for i, t in rows}
    marked = spark.createDataFrame([(n, hash(p) if n in (0, 301) else None) for n, p in of.values()], "len int, prefix long")
    assert sorted(r.len for r in exact_dedup.shared_prefixes(marked, "len", "prefix").collect()) == [0, 301]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame).collect()}
    assert got == {1: (1, 1, True), 2: (2, 1, True), 3: (6, 2, False), 4: (4, 1, True), 5: (5, 1, True), 6: (6, 2, True), 7: (8, 2, False), 8: (8, 2, True)}
    plan = exact_dedup.exact_dedup(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN len_again" in plan  # a prefix is hashed only where the length occurs again


@pytest.mark.parametrize("limit", [500_000, 0])
def test_exact_dedup_of_a_large_group(spark, limit, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK", 20)
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(300)] + [(7, "same")] * 30
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=limit).collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if r.kept and r.text == "same"] == [299]
    assert {(r.keep_id, r.group_size) for r in got if r.text == "same"} == {(299, 230)}
    assert all(r.kept and r.group_size == 1 for r in got if r.text != "same")


@pytest.mark.parametrize("limit", [500_000, 0])
def test_exact_dedup_keeps_one_of_rows_that_repeat(spark, limit):
    rows = [(9, "t", i) for i in range(50)] + [(1, "t", -1)] + [(None, "n", i) for i in range(20)] + [(5, None, 0), (5, "", 0), (6, "alone", 0)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, no int").repartition(7), broadcast_rows=limit)
    got = found.collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter((i, t or "") for i, t, _ in rows)
    assert Counter((r.doc_id, r.text or "") for r in got if r.kept) == {(9, "t"): 1, (None, "n"): 1, (5, ""): 1, (6, "alone"): 1}
    assert {(r.text, r.group_size) for r in got} >= {("t", 51), ("n", 20), ("alone", 1)}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # no task gathers the rows of a key


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The contract's own words: stop at twice the size, share the excess again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    target = {s: total * w[s] / sum(w.values()) for s in names}
    for _ in range(1000):
        excess = sum(max(0, target[s] - most * sizes[s]) for s in names)
        if excess < 1e-9:
            break
        target = {s: min(target[s], most * sizes[s]) for s in names}
        free = [s for s in names if target[s] < most * sizes[s]]
        for s in free:
            target[s] += excess * w[s] / sum(w[f] for f in free)
    return target


def check_mix(rows, got):
    sizes, taken, longest = Counter(), Counter(), Counter()
    for (i, t, s, *_), r in zip(rows, got, strict=True):
        n = len(re.findall("[^\x20\x09-\x0d]+", t or ""))
        assert r["size"] == n and 0 <= r.taken <= 2 * n
        sizes[s] += n
        taken[s] += r.taken
        longest[s] = max(longest[s], n)
    target = brute_targets(sizes)
    for (_, _, s, *_), r in zip(rows, got, strict=True):
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s]
    return taken, target


def test_mix_sources_reaches_targets(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got, again = (Q.op8_mix_sources(spark, sf).orderBy("doc_id").collect() for _ in range(2))
    assert got == again
    check_mix(rows, got)


@pytest.mark.parametrize("sources", [100_000, 2])
def test_mix_sources_awkward(spark, sources, monkeypatch):
    """Null ids, null texts and sources, repeated rows, sources of no words; sources beyond the broadcast too."""
    monkeypatch.setattr(mixing, "SOURCES", sources)
    monkeypatch.setattr(shared, "CHUNK", 30)
    rows = AWKWARD + [(20 + i, "w " * (i % 9), f"z{i % 4}", "en") for i in range(200)]
    frame = docs(spark, rows).withColumnRenamed("KEPT", "Mix_Key")
    mixed = mixing.mix_sources(frame)
    assert mixed.columns == ["doc_id", "text", "source", "lang", "Mix_Key", "size", "source_size", "target", "copies", "taken"]
    order = lambda r: (r[0] is None, r[0] or 0, r[2] or "", r[1] or "")
    got = sorted(mixed.collect(), key=order)
    assert Counter(tuple(r[:4]) for r in got) == Counter(rows) and all(r["Mix_Key"] == "mine" for r in got)
    check_mix(sorted(rows, key=order), got)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mix_sources(docs(spark, [(1, None, None, None), (1, None, None, None)])).where("target = 0 and taken = 0").count() == 2
    for most in (1.5, 0):
        with pytest.raises(ValueError):
            mixing.mix_sources(frame, most=most)
    once = mixing.mix_sources(frame, most=1, share=5).collect()
    assert all(r.taken == r["size"] and r.target == r.source_size for r in once)


@pytest.mark.parametrize("parts", [50_000, 20])
def test_rows_that_repeat_id_and_text_go_one_by_one(spark, parts, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL", parts)
    rows = [(1, "a b c d", "s0", "en")] * 100 + [(2, "e f", "s1", "en")] * 50 + [(3, "g", "s2", "en")] * 10 + [(4 + i, "h i j", "s3", "en") for i in range(40)]
    got = mixing.mix_sources(docs(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    for source in ("s0", "s1", "s2", "s3"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 * max(r["size"] for r in own)
        assert all(r.taken <= 2 * r["size"] for r in own)


@pytest.mark.parametrize("name", ["threshold", "passes", "MIX_HASH", "mix_row", "carried", "one_more", "mix_part", "n", "floor", "need", "target", "copies", "Size"])
def test_mix_sources_with_its_own_names(spark, name):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.doc_id: (r.source_size, r.target, r.copies) for r in mixing.mix_sources(plain).collect()}
    got = mixing.mix_sources(plain.withColumn(name, F.lit("mine")))
    assert {r.doc_id: (r.source_size, r.target, r.copies) for r in got.collect()} == want
    if name.lower() not in ("target", "copies", "size"):
        assert {r[name] for r in got.collect()} == {"mine"}


@pytest.mark.parametrize("name", ["rows", "source", "plain", "safe", "body", "turns", "conv", "row", "Formatted", "identical", "segments"])
def test_format_chat_of_ids_with_its_own_names(spark, name):
    rows = [(7, 0, "user", "hi"), (7, 1, "assistant", "</s>"), (8, 0, "user", "x")]
    frame = spark.createDataFrame([(*r, "mine", "mine") for r in rows], f"{name} long, at long, role string, text string, source2 string, conv2 string")
    done = chat_format.format_chat(frame, conv_col=name, turn_col="at")
    own = lambda n: f"_{n}" if n == name.lower() else n
    assert done.columns == [name, *map(own, ("formatted", "segments", "turns", "identical"))]
    assert sorted((r[name], r[own("identical")], len(r[own("turns")])) for r in done.collect()) == [(7, True, 2), (8, True, 1)]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    compare(spark, Q.queries()[name], Q.oracle_sql()[name], sf)


TURNS = "conv_id long, turn long, role string, text string, formatted string"


def brute_turns(rows):
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def check_chat(rows, got):
    want = brute_turns(rows)
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.identical and r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_chat_format_matches_source(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    check_chat([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)], Q.op6_chat_format(spark, sf).collect())


def test_chat_format_conflicts(spark):
    bits = ["[INST]", "[/INST]", "</s>", "\\", "[\\INST]", "<\\/s>", "<", "[/INS", "T]", "[", "\\\\[INST]", "\n", "", None, "é😀"]
    rows = [(i, 0, "user", a + (b or "")) for i, (a, b) in enumerate((a or "", b) for a in bits for b in bits)]
    rows += [(1000, t, r, x) for t, r, x in ((1, "assistant", "[/INST]"), (None, None, None), (1, "a[/INST]\\", "</s>"), (1, "assistant", "[/INST]"))]
    rows += [(None, 0, "assistant", "x"), (None, 0, "system", "y" * 200_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    done = chat_format.format_chat(frame)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    got = done.select(
        "conv_id", "identical", F.size("turns").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(chat_format.loss_text(F.col("segments"))).alias("loss_chars"), F.sha2(chat_format.loss_text(F.col("segments")), 256).alias("loss_sha256"),
    ).collect()
    check_chat(rows, got)
    joined = F.array_join(F.transform("segments", lambda s: s["piece"]), "")
    assert done.where(joined != F.col("formatted")).count() == 0
    plain = done.where("conv_id = 0").first()
    assert plain.formatted == "[INST]user[/INST][\\INST][\\INST]</s>"
    assert chat_format.format_chat(frame.limit(0)).count() == 0
