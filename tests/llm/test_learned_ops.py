import math
import pickle
import tracemalloc
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import lang_id, neighbours, shared, url_filter
from millrace.llm import queries as Q

from .helpers import AWKWARD, LONG, docs


def brute_ngrams(text):
    """Counts by plain string slicing, over words with their ends marked."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    counts = defaultdict(int)
    for word in letters.split():
        marked = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                if marked[i : i + n].strip():
                    counts[marked[i : i + n]] += 1
    return dict(counts)


@pytest.mark.parametrize("text", ["Abc, abc d!", "É é  x", "a", "1 2", "Straße İx 漢字 \U0001f600y", "ab" * 50 + " c"])
def test_ngram_counts(text, monkeypatch):
    for chunk in (1 << 20, 5):
        monkeypatch.setattr(lang_id, "CHUNK", chunk)
        grams, counts = lang_id.ngram_counts(text)
        read = {"".join(chr(int(g) >> 21 * k & 0x1FFFFF) for k in range(3) if int(g) >> 21 * k): int(c) for g, c in zip(grams, counts)}
        assert read == brute_ngrams(text)


def brute_predict(text, ranked):
    counts = brute_ngrams(text)
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    own = sorted(counts, key=lambda g: (-counts[g], code(g)))[: lang_id.PROFILE]
    far = {}
    for lang, grams in ranked.items():
        place = {g: i for i, g in enumerate(grams)}
        far[lang] = sum(abs(i - place[code(g)]) if code(g) in place else lang_id.PROFILE for i, g in enumerate(own))
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (lang_id.PROFILE * len(own))


def test_language_of_held_out_documents(spark, sf):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op10_language_id(spark, sf).collect()
    assert len(got) == len(rows)
    right = [r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out]
    assert right and np.mean(right) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    fitted = lang_id.fit_profiles(spark.read.parquet(f"{sf}/documents.parquet").where(~lang_id.held_out()))
    ranked = fitted.ranked()
    for r in got[:40]:
        lang, score = brute_predict(rows[r.doc_id].text, ranked)
        assert r.lang_pred == lang and r.score == pytest.approx(score)


def test_language_awkward(spark):
    found = lang_id.learn_and_identify(docs(spark, AWKWARD))
    got = found.collect()
    assert len(got) == len(AWKWARD) and "KEPT" in found.columns
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert lang_id.learn_and_identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in lang_id.learn_and_identify(docs(spark, [(1, "abc", "s", None)])).collect()} == {"und"}
    assert lang_id.Profiles({"en": [ord("w")]}).predict(LONG)[0] == "en"


def test_fit_sample_is_bounded(spark):
    """Every row has a letter of its own, in four n-grams, so the profile tells how many rows were read."""
    many = docs(spark, [(i, chr(0x4E00 + i), "s", "de") for i in range(2000)])
    known = lang_id.fit_profiles(many, fit_rows=20).known
    assert 4 * 5 <= len(known) <= 4 * 60 and len(known) % 4 == 0
    assert len(lang_id.fit_profiles(many.limit(50), fit_rows=50).known) == 200


def test_batches_are_bounded_while_profiles_are_fitted(spark, monkeypatch):
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(n) for n in names]
    seen = []
    monkeypatch.setattr(lang_id, "materialize", lambda df, tag: (seen.append([spark.conf.get(n) for n in names]), shared.materialize(df, tag))[1])
    try:
        for n in names:
            spark.conf.set(n, "1000000000")
        lang_id.fit_profiles(docs(spark, [(1, "some words", "s", "en")]))
        assert seen == [["4000", str(8 << 20)]] == [[spark.conf.get(n) for n in names]]
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)


def test_thousands_of_languages(spark):
    """5,000 languages of 300 n-grams each, drawn from 100,000: a dense table of ranks would have 4 GB. The nearest one is found."""
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in range(0x4E00, 0x9000)]
    ranked = {f"l{i:04}": [ord(letters[(i * 7 + j * 131) % len(letters)]) | int(rng.integers(0, 5)) << 21 for j in range(300)] for i in range(5000)}
    profiles = lang_id.Profiles(ranked)
    assert len(pickle.dumps(profiles)) < 60 << 20 and len(profiles.langs) == 5000
    own = " ".join(letters[(123 * 7 + j * 131) % len(letters)] for j in range(300))
    tracemalloc.start()
    profiles.predict(own)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    rows = [(i, letters[i % 3000] * 3 + letters[i % 2999 + 5000] * 2, "s", f"l{i % 1500}") for i in range(3000)]
    found = lang_id.learn_and_identify(docs(spark, rows)).collect()
    assert len({r.lang for r in found}) == 1500 and sum(r.lang_pred == r.lang for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 != 2) > 2000


def test_distances_against_their_definition():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    ranked = {f"l{i}": [int(g) for g in lang_id._ranked(*lang_id.ngram_counts(t), 50 + i).view(np.int64)] for i, t in enumerate(texts[:8])}
    profiles = lang_id.Profiles(ranked)
    for text in texts:
        grams = lang_id._ranked(*lang_id.ngram_counts(text), lang_id.PROFILE).view(np.int64).tolist()
        far = {lang: sum(abs(own.index(g) - k) if g in own else lang_id.PROFILE for k, g in enumerate(grams)) for lang, own in ranked.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert profiles.predict(text) == (best, pytest.approx(1 - far[best] / (lang_id.PROFILE * len(grams))))


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/19": ("example.org", "/en/19", "example.org/en/1", "block"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://y.com/fr/": ("y.com", "/fr/", "com/fr/", "allow"),
        "x://y.com/de/?a=://org/": ("y.com", "/de/", "com/de/", "block"),
        "x://org": ("org", "", None, None),
        "x://telecom/fr/": ("telecom", "/fr/", None, None),
        "x://Ünï.com#/de/": ("Ünï.com", "", None, None),
        "x://a?b://c.org/": ("a", "", None, None),
        "x://": ("", "", None, None),
        "no scheme.org/": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "a://b.com/" + "fr/" * 30_000: ("b.com", "/" + "fr/" * 30_000, "com/fr/", "allow"),
    }
    rows = [(i, u, "<p>fr es de</p>", "mine") for i, u in enumerate(cases)] + [(None, None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, VERDICT string")
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block") and r.block_odds is not None
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_unigrams_count_all_words_but_those_of_urls(spark):
    rows = [("<b class='x'>Aa bb</b> aa cc http://ee.ff/gg",), ("aa bb<br>dd ee " + "long" * 9,), (None,), ("",)]
    words = url_filter.unigrams(spark.createDataFrame(rows, "html string"))
    assert {r.word: r.n for r in words.collect()} == {"aa": 3, "bb": 2, "cc": 1, "dd": 1, "ee": 1, "long" * 9: 1}
    assert url_filter.unigrams(spark.createDataFrame([], "html string")).count() == 0


def brute_split(name, counts, total):
    """All splits, by recursion."""
    cost = lambda w: np.log((total + 1) / counts[w]) if w in counts and w != name else np.log(total + 1) + np.log(10) * (len(w) - 1)

    def every(rest):
        if not rest:
            yield 0.0, []
        for i in range(1, len(rest) + 1):
            for c, ws in every(rest[i:]):
                yield c + cost(rest[:i]), [rest[:i], *ws]

    return min(every(name), key=lambda x: x[0])


def test_segmenter_finds_the_likeliest_split(spark):
    counts = {"the": 50, "sun": 5, "flower": 4, "sunflower": 1, "s": 1, "hop": 3, "shop": 3, "thesunflowershop": 90}
    total = sum(counts.values())
    assert url_filter.best_split("thesunflowershop", counts, total) == ["the", "sunflower", "shop"]
    names = ["thexsun", "hops", "flowers", "zzz", "thesunflowershop", "s", "sunshop"]
    words = shared.materialize(spark.createDataFrame(list(counts.items()), "word string, n long"), "test")
    got = {r.name: r.words for r in url_filter.segmented(spark.createDataFrame([(n,) for n in names * 2], "name string"), words).collect()}
    assert set(got) == set(names)
    for name in names:
        assert got[name] == brute_split(name, counts, total)[1]
    assert len(url_filter.best_split("ab" * 5000, {"ab": 3}, 9)) == 5000


def brute_url_features(rows, words, total, splits):
    out = {}
    for host, path in rows:
        found = []
        for kind, part in (("h", host), ("p", path)):
            for run in regex.findall(r"\p{L}+|\p{Nd}+", part.lower()):
                if run[0].isdigit():
                    found.append(f"{kind}#{len(run)}")
                elif kind == "p":
                    found.append(f"p:{run}")
                else:
                    if run not in splits:
                        splits[run] = brute_split(run, words, total)[1]
                    found += [f"h:{w}" for w in splits[run]]
        out[host, path] = found
    return out


def brute_odds(trained, found):
    """trained: verdict -> feature lists."""
    counts = {v: Counter(b for f in trained[v] for b in f) for v in trained}
    kinds = len(set().union(*counts.values()))
    log_p = lambda v: np.log(len(trained[v]) + 1) + sum(np.log((counts[v][b] + 1) / (counts[v].total() + kinds + 1)) for b in found)
    return log_p("block") - log_p("allow")


def test_url_verdicts_match_brute_force_and_names_are_split(spark, sf):
    """Words, splits, features and odds again in plain Python; then what the split changes, and held-out accuracy."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = Q.op4_url_filter(spark, sf).collect()
    assert len(got) == pages.count()
    shown = [re.sub(r"<[^>]*>|[A-Za-z][A-Za-z0-9+.-]*://\S*", " ", r.html or "").lower() for r in pages.collect()]
    words, splits = Counter(w for t in shown for w in regex.findall(r"\p{L}+", t)), {}
    features = brute_url_features({(r.host, r.path) for r in got}, words, words.total(), splits)
    trained = {v: [features[r.host, r.path] for r in got if r.rule and r.verdict == v] for v in ("allow", "block")}
    for r in got:
        if r.rule is None:
            odds = brute_odds(trained, features[r.host, r.path])
            assert r.block_odds == pytest.approx(odds, abs=1e-6) and r.verdict == ("block" if odds > 0 else "allow")
        else:
            assert r.block_odds is None

    split = {n for n, ws in splits.items() if len(ws) > 1}
    assert len(split) > len(splits) / 2 and all(w in words for n in split for w in splits[n] if len(w) > 3)
    assert any({f"h:{w}" for w in splits[n]} <= set(features[r.host, r.path]) and f"h:{n}" not in features[r.host, r.path] for r in got for n in split if n in r.host)


def test_held_out_urls_that_rules_decide(spark, sf):
    """Fitted on three quarters of the ruled URLs of a larger table; the rest is predicted from its words alone."""
    pages = spark.read.parquet(f"{sf}/../sf0.1/pages.parquet")
    parts = pages.select(url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"))
    rule = url_filter.matching_rule(F.col("host"), F.col("path"))["verdict"]
    ruled = parts.withColumn("verdict", rule).where("verdict is not null").groupBy("host", "path", "verdict").agg(F.lit(1).alias("n"))
    told = url_filter.with_tokens(shared.materialize(ruled.withColumnRenamed("n", "pages"), "test"), url_filter.unigrams(pages)).withColumnRenamed("pages", "n")
    told = shared.materialize(told.withColumn("held", F.crc32(F.concat("host", "path")) % 4 == 0), "test")
    by_rule = F.array(*[F.lit(f"p:{x}") for x in ("es", "en", "fr", "de")])
    accuracy = {}
    for name, rows in (("all", told), ("without the rules' path words", told.withColumn("tokens", F.array_except("tokens", by_rule)))):
        scores = url_filter.score_urls(rows.where("held"), url_filter.fit_bayes(rows.where("not held")))
        met = scores.join(rows, ["host", "path"]).agg(F.avg(((F.col("block_odds") > 0) == (F.col("verdict") == "block")).cast("double")), F.count("*"))
        accuracy[name] = met.first()
    print(accuracy)
    assert accuracy["all"][1] > 100 and accuracy["all"][0] > 0.95


def brute_nearest(rows, k=20):
    """rows: (id, vector) that take part, once each -> query id -> [(id, score)]."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            score = x @ np.array(v)
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != i]
            out[i] = [(int(ids[j]), float(score[j])) for j in order[:k]]
    return out


def recall(got, want):
    return np.mean([len({g[0] for g in got.get(q, [])} & {w[0] for w in want[q]}) / len(want[q]) for q in want])


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute_nearest(rows), found(Q.op5_nearest_neighbours(spark, sf))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    x = {i: np.array(v, dtype=float) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 20 and q not in [i for i, _ in near]
        assert [s for _, s in near] == pytest.approx([float(x[q] @ x[i]) for i, _ in near], abs=1e-12)
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))


def test_clustered_vectors_open_few_leaves(spark):
    """20,000 vectors of uneven length around 100 centres: recall, and the share of the table that a query is scored against."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((100, 64))[rng.integers(0, 100, 20_000)] + 0.4 * rng.standard_normal((20_000, 64))
    x = np.float32(x * rng.uniform(0.9, 1.1, (20_000, 1))).astype(float)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = found(neighbours.nearest(frame, F.col("vec_id") % 200 == 0))
    want = {i: [(int(j), 0) for j in np.argsort(-(x @ x[i]), kind="stable") if j != i][:20] for i in range(0, 20_000, 200)}
    assert recall(got, want) > 0.95

    norm = float(np.linalg.norm(x, axis=1).max())
    lifted = neighbours._lifted(x, norm)
    forest = neighbours.Forest(lifted, len(x))
    leaf = forest.leaves(lifted)
    assert forest.depth == 9 and len(np.unique(leaf)) == 3 << 9
    scored = []
    for i in range(0, 20_000, 200):
        q = neighbours._scaled(x[i : i + 1], norm)[0]
        first = list(itertools.islice(forest.opened(q), neighbours.FIRST))
        kth = np.sort(x[np.isin(leaf, first).any(axis=1)] @ x[i])[-21]
        limit = neighbours.SLACK * 2 * norm * (norm - kth / np.linalg.norm(x[i])) / 65
        scored.append(np.isin(leaf, [*first, *forest.opened(q, limit)]).sum() / len(x))
    assert np.mean(scored) < 0.4


def test_vectors_without_structure_cost_no_more_than_all_of_them():
    """Once a query has opened as many leaves as a tree has, it reads one tree whole: every entry once, beside its first leaves."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    lifted = neighbours._lifted(x, norm := float(np.linalg.norm(x, axis=1).max()))
    forest = neighbours.Forest(lifted, len(x))
    leaf = forest.leaves(lifted)
    for q in neighbours._scaled(x[:20], norm):
        first = list(itertools.islice(forest.opened(q), neighbours.FIRST))
        every = forest.enough(q, math.inf)
        assert len(every) == 1 << forest.depth and len(set((every >> forest.depth).tolist())) == 1
        held = np.isin(leaf, every)
        assert (held.sum(axis=1) == 1).all() and held.sum() + np.isin(leaf, np.setdiff1d(first, every)).sum() <= len(x) + neighbours.FIRST * 2 * neighbours.LEAF
        some = forest.enough(q, 1e-9)
        assert 0 < len(some) < 1 << forest.depth


def test_a_vector_that_a_third_of_the_rows_have(spark, monkeypatch):
    """Rows that repeat an id, and queries that share a vector, are dealt out; ties go to the smaller ids."""
    monkeypatch.setattr(shared, "CHUNK", 10)
    rng = np.random.default_rng(6)
    rows = [(i % 200, [1.0, 2.0, 3.0]) for i in range(600)] + [(1000 + i, rng.standard_normal(3).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = found(neighbours.nearest(frame, F.col("vec_id") % 2 == 0, k=5))
    want = brute_nearest_of(dict(rows), lambda i: i % 2 == 0, 5)
    assert {q: [i for i, _ in near] for q, near in got.items()} == want


def brute_nearest_of(vectors, asks, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = {}
    for i, v in zip(ids, x):
        if asks(i):
            order = [j for j in np.lexsort((ids, -np.round(x @ v, 9))) if ids[j] != i]
            out[int(i)] = [int(ids[j]) for j in order[:k]]
    return out


def test_forest_queue_is_in_order_of_its_bounds():
    rng = np.random.default_rng(3)
    forest, q = neighbours.Forest(rng.standard_normal((4096, 8)), 1 << 20), rng.standard_normal(8)
    assert forest.depth == 14 and [len(c) for c in forest.cuts[0]] == [1 << level for level in range(7)] + [1] * 7

    def bound(leaf):
        t, node, far = leaf >> forest.depth, leaf & ((1 << forest.depth) - 1), 0.0
        for level, cuts in enumerate(forest.cuts[t]):
            at = node >> (forest.depth - level)
            margin = forest.normals[t, level] @ q - cuts[at if len(cuts) > 1 else 0]
            far += margin**2 * ((margin > 0) != (node >> (forest.depth - level - 1) & 1))
        return far

    opened = list(itertools.islice(forest.opened(q), 500))
    far = [bound(leaf) for leaf in opened]
    assert len(set(opened)) == 500 and far == pytest.approx(sorted(far)) and far[:3] == pytest.approx([0, 0, 0])
    within = list(forest.opened(q, far[99]))
    assert within[:99] == opened[:99] and max(map(bound, within)) <= far[99] + 1e-9


def test_neighbours_awkward(spark, monkeypatch):
    """A third of the rows share one vector; others are null, zero, infinite, short or repeated. All leaves are opened."""
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(8).tolist()
    rows = [(i, hot) for i in range(0, 300)] + [(i, rng.standard_normal(8).tolist()) for i in range(300, 900)]
    rows += rows[:5] + [(900, None), (920, [0.0] * 8), (940, [float("nan")] + [1.0] * 7), (960, [None] * 8), (980, [float("inf")] * 8)]
    rows += [(1000, [1.0] * 7), (None, hot)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, RANK int")
    fine = [(i, np.float32(v).tolist()) for i, v in rows if i is not None and i < 900]
    monkeypatch.setattr(neighbours, "MEMBERS", 100)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    query = F.col("vec_id") % 20 == 0
    got, want = found(neighbours.nearest(frame, query, slack=1e9)), brute_nearest(fine)
    assert {q: [i for i, _ in n] for q, n in got.items()} == {q: [i for i, _ in n] for q, n in want.items()}
    few = frame.where("vec_id in (0, 20, 301)")
    assert {q: [i for i, _ in n] for q, n in found(neighbours.nearest(few, query)).items()} == {q: [i for i, _ in n] for q, n in brute_nearest([f for f in fine if f[0] in (0, 20, 301)]).items()}
    assert neighbours.nearest(frame.limit(0), query).count() == 0
    assert neighbours.nearest(frame, F.lit(False)).count() == 0
