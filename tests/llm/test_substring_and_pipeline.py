import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from millrace.llm import bpe, shared, substring_dedup
from millrace.llm import queries as Q

from .helpers import AWKWARD, docs, sha
from .test_native_ops import brute_exact, brute_targets
from .test_simhash import brute_components, brute_fingerprint, close


def brute_passages(texts, paragraph=5, run=51, common=None):
    """texts: (id, text), ids unique, in their order. The job said again by words and pairs; common: documents that may share a short line.

    Returns of each document the words that go, those that stay as a first copy, its words, and the runs that must stay.
    """
    lines = [[line.split() for line in (t or "").lower().split("\n")] for _, t in texts]
    words = [[w for line in ls for w in line] for ls in lines]
    found = []
    for d, ls in enumerate(lines):
        at = 0
        for line in ls:
            if len(line) >= paragraph:
                found.append((d, at, len(line), frozenset(tuple(line[k : k + 5]) for k in range(len(line) - 4))))
            at += len(line)
    near = lambda a, b: 4 * len(a) <= 5 * len(b) and 4 * len(b) <= 5 * len(a) and 10 * len(a & b) >= 8 * len(a | b)
    sets = {f[3]: i for i, f in enumerate(found)}
    low = brute_components([(i, i) for i in sets.values()], lambda a, b: near(found[a][3], found[b][3]))
    classes = defaultdict(list)
    for f in found:
        classes[low[sets[f[3]]]].append(f[:3])
    lost, stay = ([[False] * len(w) for w in words] for _ in range(2))
    for own in classes.values():
        if common is not None and len({d for d, _, _ in own}) > common and max(size for _, _, size in own) < 15:
            continue
        if len({d for d, _, _ in own}) > 1:
            for n, (d, at, size) in enumerate(sorted(own)):
                (lost if n else stay)[d][at : at + size] = [True] * size
    where = defaultdict(list)
    for d, w in enumerate(words):
        for k in range(len(w) - run + 1):
            if not all(lost[d][k : k + run]):
                where[tuple(w[k : k + run])].append((d, k))
    shared = {g: sorted(at) for g, at in where.items() if len({d for d, _ in at}) > 1}
    later, first = ([[False] * len(w) for w in words] for _ in range(2))
    for at in shared.values():
        for n, (d, k) in enumerate(at):
            (later if n else first)[d][k : k + run] = [True] * run
    goes = [[(a or b) and not c for a, b, c in zip(*x)] for x in zip(lost, later, first)]
    stays = [[c or (p and not g) for c, p, g in zip(*x)] for x in zip(first, stay, goes)]
    return goes, stays, words, shared


def check_passages(spark, rows, frame=None, common=None):
    """Rows by brute force, and that every run that is cut somewhere still stands in the cut texts."""
    texts = [(r[0], r[1]) for r in rows]
    goes, stays, words, shared = brute_passages(texts, common=None if common is None else common * len(texts))
    frame = frame or docs(spark, [(i, t, "s", "en") for i, t in texts])
    passages = substring_dedup.repeated_passages(frame, common=common)
    no, got = {i: d for d, (i, _) in enumerate(texts)}, passages.collect()
    mine = [[set() for _ in texts] for _ in range(2)]
    for r in got:
        mine[r.removed][no[r.doc_id]].update(range(r.start_word, r.start_word + r.n_words))
    for d in range(len(texts)):
        assert mine[True][d] == {k for k, x in enumerate(goes[d]) if x}, texts[d][0]
        assert mine[False][d] == {k for k, x in enumerate(stays[d]) if x}, texts[d][0]
    of = defaultdict(lambda: defaultdict(set))
    for r in got:
        of[r.doc_id][r.class_id].add((r.keep_id, r.start_word, r.start_word + r.n_words))
    for at in shared.values():  # documents that share a run share a class, and those that cut it name who keeps it
        together = [{c for c, spans in of[texts[d][0]].items() if any(a < k + 51 and k < b for _, a, b in spans)} for d, k in at]
        assert set.intersection(*together)
    left = {r.doc_id: (r.text or "").lower().split() for r in substring_dedup.cut_passages(frame, passages).collect()}
    for d, (i, t) in enumerate(texts):
        assert left[i] == [w for w, gone in zip(words[d], goes[d]) if not gone]
    standing = {tuple(w[k : k + 51]) for w in left.values() for k in range(len(w) - 50)}
    assert shared.keys() <= standing
    return got


def test_passages_of_the_table(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    check_passages(spark, rows, documents)
    got = check_passages(spark, rows, documents, common=0.001)
    assert Counter(got) == Counter(Q.op3_substring_dedup(spark, sf).collect()) and any(r.removed for r in got)


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_mixed_texts(spark, seed):
    """Blocks in running text, as lines, hard-wrapped, with edits, repeated inside a text, beside short lines."""
    rng, rows = random.Random(seed), []
    blocks = [words(rng, rng.choice([12, 20, 45, 60, 120])) for _ in range(14)]
    for i in range(60):
        w, shape = [], rng.randrange(4)
        for b in rng.choices(range(14), k=rng.randrange(1, 5)):
            block = list(blocks[b])
            if rng.random() < 0.3:
                block[rng.randrange(len(block))] = "edited"
            lead = words(rng, rng.choice([0, 3, 70]))
            w.append("\n".join(map(" ".join, (lead, block))) if shape == 0 else " ".join(lead + block))
        text = ("\n" if shape < 2 else " ").join(w).split(" ")
        if shape == 3:
            text = [x + "\n" * (k % 12 == 11) for k, x in enumerate(text)]
        rows.append((i, "  ".join(text)))
    rows += [(60, "la " * 130), (61, "LA " * 90 + "x"), (None, " ".join(blocks[4] + words(rng, 80) + blocks[0]))]
    check_passages(spark, rows)


def test_no_copy_of_a_passage_is_lost(spark):
    """A, A+B, B, A+B; paragraphs and running text alike; two rows of one id; rows without an id; a 45-word line."""
    rng = random.Random(6)
    a, b, line = (" ".join(words(rng, n)) for n in (120, 120, 45))
    for joint in (" ", "\n"):
        rows = [(1, a), (2, a + joint + b), (3, b), (4, a + joint + b)]
        got = check_passages(spark, rows)
        left = {r.doc_id: r.text.split() for r in substring_dedup.cut_passages(docs(spark, [(*r, "s", "en") for r in rows]), substring_dedup.repeated_passages(docs(spark, [(*r, "s", "en") for r in rows]))).collect()}
        assert left[1] == a.split() and left[2][-120:] == b.split() and left[3] == left[4] == []
        assert {r.keep_id for r in got if r.doc_id == 3} == {2}
    other = " ".join(words(rng, 200))
    rows = [(9, a, "s", "en"), (9, other, "s", "en"), (None, other + " " + a, "s", "en"), (None, b, "s", "en"), (2, "x " + b, "s", "en")]
    frame = docs(spark, rows)
    left = Counter(r.text for r in substring_dedup.cut_passages(frame, substring_dedup.repeated_passages(frame)).collect())
    assert left == Counter([a, other, "", "", "x " + b])
    rows = [(i, "\n".join([" ".join(words(rng, 60)), line, " ".join(words(rng, 9 + i))])) for i in range(6)]
    got = check_passages(spark, rows)
    assert {(r.doc_id, r.start_word, r.n_words, r.keep_id, r.removed) for r in got} == {(i, 60, 45, 0, i > 0) for i in range(6)}


def test_quotes_near_paragraphs_and_clean_documents(spark):
    rng = random.Random(4)
    quote, base = words(rng, 51), words(rng, 160)
    rows, near, at = [], [], {}
    for i in range(40):  # a quote anywhere in running text
        w = words(rng, 200)
        at[i] = rng.randrange(200)
        rows.append((i, " ".join(w[: at[i]] + quote + w[at[i] :]), "s", "en"))
    for i in range(40, 80):  # one paragraph with a word changed here and there
        w = list(base)
        for _ in range(2):
            w[rng.randrange(160)] = "edited"
        near.append(i)
        rows.append((i, "\n".join([" ".join(words(rng, 60)), " ".join(w), " ".join(words(rng, 20))]), "s", "en"))
    rows += [(i, " ".join(words(rng, 300)), "s", "en") for i in range(80, 120)]
    inside = words(rng, 60)
    rows.append((120, " ".join(inside + words(rng, 9) + inside), "s", "en"))  # a repeat in one document only
    frame = docs(spark, rows)
    passages = substring_dedup.repeated_passages(frame)
    got = passages.collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.removed) for r in got if r.doc_id < 40} == {(i, at[i], 51, i > 0) for i in range(40)}
    assert {(r.doc_id, r.start_word, r.n_words, r.removed) for r in got if r.doc_id >= 40} == {(i, 60, 160, i > 40) for i in near}
    of = {name: {r.class_id for r in got if r.doc_id in ids} for name, ids in (("quote", range(40)), ("near", near))}
    assert len(of["quote"]) == len(of["near"]) == 1 and of["quote"] != of["near"] and {r.keep_id for r in got} == {0, 40}
    left = {r.doc_id: r.text for r in substring_dedup.cut_passages(frame, passages).collect()}
    text = {r[0]: r[1] for r in rows}
    assert all(left[i] == text[i] for i in (0, 40, *range(80, 121)))


def test_least_paragraph(spark):
    """Lines of one shingle count if asked for; shorter ones never do."""
    rows = [(i, f"one two three four five\nfour words at most\n{i} own {i} line {i} is long {i} enough", "s", "en") for i in range(3)]
    found = lambda n: {(r.doc_id, r.start_word, r.n_words, r.removed) for r in substring_dedup.repeated_passages(docs(spark, rows), paragraph=n).collect()}
    assert found(5) == found(1) == {(i, 0, 5, i > 0) for i in range(3)} and found(6) == set()


def test_short_lines_that_many_documents_have(spark):
    """With a share of documents as the bound, lines below it go as any other; longer lines always do."""
    rng = random.Random(12)
    menu, licence, long = (" ".join(words(rng, n)) for n in (6, 14, 15))
    rows = [(i, "\n".join([" ".join(words(rng, 30)), *[menu] * (i < 9), *[licence] * (i < 4), *[long] * (i < 9)])) for i in range(20)]
    for common, kept in ((None, ()), (0.3, (menu,)), (0.1, (menu, licence)), (0.5, ())):
        check_passages(spark, rows, common=common)
        frame = docs(spark, [(*r, "s", "en") for r in rows])
        left = {r.doc_id: r.text for r in substring_dedup.cut_passages(frame, substring_dedup.repeated_passages(frame, common=common)).collect()}
        assert [x in left[3] for x in (menu, licence, long)] == [menu in kept, licence in kept, False]


def test_short_lines_that_many_documents_have_are_told_exactly(spark):
    """What the bound leaves out and what it leaves in are together what there is without it."""
    rng = random.Random(15)
    menu, licence, long = (" ".join(words(rng, n)) for n in (10, 14, 15))
    near = menu.replace(menu.split()[0], "edited")
    rows = [(i, "\n".join([" ".join(words(rng, 30)), *[near if i == 3 else menu] * (i < 9), *[licence] * (i < 4), *[long] * (i < 9)]), "s", "en") for i in range(20)]
    frame = docs(spark, rows)
    told = lambda common: Counter(tuple(r) for r in substring_dedup.repeated_passages(frame, common=common).collect())
    rest = lambda common: Counter((*tuple(r)[:-1], not r.first) for r in substring_dedup.common_lines(frame, common).collect())
    every = told(None)
    for common, n in ((0.3, 8), (0.1, 12), (0.5, 0), (0.0, 12)):
        left_out = rest(common)
        assert told(common) + left_out == every and sum(left_out.values()) == n
    assert rest(0.1).keys() == {r for r in every if r[3] < 15} and {"op3_substring_dedup", "common_lines"} <= set(Q.queries())


def test_shorter_quotes(spark):
    rng = random.Random(13)
    quote = words(rng, 25)
    rows = [(i, " ".join([*words(rng, 40), *quote, *words(rng, 40)]), "s", "en") for i in range(4)]
    found = lambda n: sorted((r.doc_id, r.start_word, r.n_words, r.removed) for r in substring_dedup.repeated_passages(docs(spark, rows), quote=n).collect())
    assert found(25) == [(i, 40, 25, i > 0) for i in range(4)] and found(26) == []
    with pytest.raises(ValueError):
        found(20)


def test_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK", 7)
    rng = random.Random(8)
    base = words(rng, 120)
    sets = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        sets.append(np.unique(np.array([hash(tuple(w[k : k + 5])) % 2**64 for k in range(116)], dtype=np.uint64)))
    bands = spark.createDataFrame([(2 * i, [1, 2 + i % 3]) for i in range(60)], "key long, bands array<long>")
    held = spark.createDataFrame([(2 * i, s.tobytes()) for i, s in enumerate(sets)], "key long, shingles binary")
    similar = lambda a, b: len(np.intersect1d(sets[a // 2], sets[b // 2])) >= 0.8 * len(np.union1d(sets[a // 2], sets[b // 2]))
    want = brute_components([(2 * i, 2 * i) for i in range(60)], similar)
    for part in (8, 512):
        edges = [(r.u, r.v) for r in substring_dedup.similar_paragraphs(substring_dedup.colliding(bands, part), held).collect()]
        assert all(similar(u, v) for u, v in edges)
        linked = {frozenset(e) for e in edges}
        assert brute_components([(2 * i, 2 * i) for i in range(60)], lambda a, b: frozenset((a, b)) in linked) == want


def test_sized_join_deals_out_large_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK", 5)
    left = spark.createDataFrame([(k, i) for k, n in (("a", 1), ("b", 5), ("c", 23), ("d", 2)) for i in range(n)], "k string, HOT_PARTS int")
    right = shared.materialize(spark.createDataFrame([("a", 1, "A"), ("b", 5, "B"), ("c", 23, "C")], "k string, n long, v string"), "test")
    inner, outer = (shared.join_sized(left, right, "k", how=how).collect() for how in ("inner", "left"))
    assert Counter((r.k, r.v) for r in inner) == {("a", "A"): 1, ("b", "B"): 5, ("c", "C"): 23}
    assert Counter((r.k, r.v) for r in outer) == {("a", "A"): 1, ("b", "B"): 5, ("c", "C"): 23, ("d", None): 2}
    assert len({(r.k, r.HOT_PARTS) for r in outer}) == 31
    assert shared.join_sized(left.limit(0), right.limit(0), "k").count() == 0


def test_every_long_enough_stretch_has_an_anchored_window():
    rng, n = np.random.default_rng(0), substring_dedup.WINDOW
    shared = rng.integers(0, 1 << 63, 51, dtype=np.uint64)
    keys = []
    for _ in range(30):
        h = np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 90), dtype=np.uint64), shared, rng.integers(0, 1 << 63, rng.integers(0, 90), dtype=np.uint64)])
        at = substring_dedup.anchors(substring_dedup._rolled(h, 5), len(h) - n)
        assert (substring_dedup._rolled_at(h, n, at) == substring_dedup._rolled(h, n)[at]).all()
        keys.append(set(substring_dedup._rolled_at(h, n, at).tolist()))
    assert set.intersection(*keys)
    assert not len(substring_dedup.anchors(substring_dedup._rolled(shared[:50], 5), 50 - n))


def test_passages_awkward(spark):
    got = substring_dedup.repeated_passages(docs(spark, AWKWARD)).collect()
    short = {(1, 0, 5, 1, False), (2, 0, 5, 1, True), (8, 0, 5, 1, True)}  # a line of one shingle
    assert {(r.doc_id, r.start_word, r.n_words, r.keep_id, r.removed) for r in got} == short | {(6, 0, 60_000, 6, False), (7, 0, 60_000, 6, True)}
    empty = docs(spark, [])
    assert substring_dedup.repeated_passages(empty).count() == 0
    for rows in (AWKWARD, []):
        frame = docs(spark, rows).withColumnsRenamed({"KEPT": "Row_Tag", "size": "CUTS"})
        cut = substring_dedup.cut_passages(frame, substring_dedup.repeated_passages(frame))
        assert cut.columns == frame.columns and cut.count() == len(rows)
        assert Counter(r.text for r in cut.collect()) == Counter("" if r[0] in (2, 7, 8) else r[1] for r in rows)
    lost = " ".join(f"n{i}" for i in range(80))
    got = substring_dedup.repeated_passages(docs(spark, [(None, lost, None, None), (3, "x " + lost, None, None), (3, "x " + lost, None, None)]))
    assert Counter((r.doc_id, r.keep_id, r.removed) for r in got.collect()) == {(None, 3, True): 1, (3, 3, False): 1}


def brute_stages(rows):
    """The first three stages on (doc_id, text, source) rows with an id of their own each."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best, _ = brute_exact([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if best[r[1]] == r[0]]
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    low = brute_components([(i, v) for i, v in prints.items()], close)
    return [r for r in rows if low[prints[r[0]]] == r[0]]


def test_pipeline_stages_match_brute_force(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    docs_now, kept = documents, brute_stages(rows)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_now, sf)
        out.write.parquet(f"file://{tmp_path}/{n}-{name}")
        docs_now = spark.read.parquet(f"file://{tmp_path}/{n}-{name}")
        if n < 4:
            assert docs_now.columns == documents.columns
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in docs_now.collect()) == sorted(r[0] for r in kept)
        if name == "mix_sources":
            mixed = Counter(r.doc_id for r in docs_now.collect())
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t)) for i, t, _ in kept}
    source, sizes, taken = {i: s for i, _, s in kept}, Counter(), Counter()
    for i in size:
        sizes[source[i]] += size[i]
        taken[source[i]] += size[i] * mixed[i]
    assert set(mixed) <= set(size) and max(mixed.values()) <= 2
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= max(size[i] for i in size if source[i] == s)
    codec, text = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN), {r[0]: r[1] for r in rows}
    end = docs_now.collect()
    assert Counter(r.doc_id for r in end) == mixed
    for r in end:
        ids = codec.encode_all([text[r.doc_id]]).to_pylist()[0]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text[r.doc_id]))
    again = corpus_pipeline.run(spark, sf).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, end))
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_awkward_tables(spark):
    for rows in (AWKWARD, []):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs(spark, rows), "")
            found = out.collect()
            assert len(found) <= 2 * len(rows)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs(spark, []).columns and all(r["size"] == r["KEPT"] == "mine" for r in found)
