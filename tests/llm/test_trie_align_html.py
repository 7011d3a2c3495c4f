import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from millrace.llm import alignment, html_extract, prefix_trie
from millrace.llm import queries as Q

from ..oracle import compare
from .helpers import AWKWARD, docs

# --- prefix trie -----------------------------------------------------------------------------------------------------

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def brute_trie(convs):
    """All prefixes, each node's subtree walked prefix by prefix."""
    nodes = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * words
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        above = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), above, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(frame):
    return sorted((tuple(r[c] for c in NODE) for r in frame.collect()), key=str)


def test_trie_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(Q.op11_prefix_trie(spark, sf)) == brute_trie(brute_rebuilt(rows))


def test_trie_gives_the_rows_of_its_sql(spark, sf):
    compare(spark, Q.op11_prefix_trie, Q.oracle_sql()["op11_prefix_trie"], sf)


def shared_prefixes(n=400, seed=0):
    """Conversations that share first turns, a third one turn and many three; repeated ones, turnless ones are not here."""
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        lead = [("system", "you are one"), ("user", "hello you"), ("assistant", "hi")][: draw.choice((0, 1, 3))]
        rest = [(draw.choice(("user", "assistant")), f"w{draw.randrange(4)} x") for _ in range(draw.randrange(5))]
        for turn, (role, text) in enumerate(lead + rest or [("user", "alone")]):
            rows.append((c, turn, role, text))
    return rows


@pytest.mark.parametrize("most", [1, 20, 100_000])
def test_trie_with_a_spine(spark, most):
    """Small limits send every shared prefix through the rounds of the spine."""
    rows = shared_prefixes()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    convs = defaultdict(list)
    for c, _, role, text in sorted(rows):
        convs[c].append((role, text))
    got = prefix_trie.sequence_trie(prefix_trie.turn_digests(frame), most=most, least=most)
    assert told(got) == brute_trie(convs)


def test_trie_of_awkward_turns(spark):
    long = "word " * 50_000
    rows = [
        (1, 0, "user", "a"), (1, None, None, None), (2, 0, "user", "a"), (2, None, "", ""), (None, 0, "user", "a"), (None, None, None, None),
        (3, 5, "user", long), (3, 7, "user", long), (4, 5, "user", long), (4, 5, "user", long), (-5, 1, "user", "a"), (300_000, 1, "user", "a"),
    ]
    frame = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "conv_id long, turn long, role string, text string, words string, K1 string")
    convs = {1: [("", ""), ("user", "a")], 2: [("", ""), ("user", "a")], 3: [("user", long)] * 2, 4: [("user", long)] * 2, -5: [("user", "a")], 300_000: [("user", "a")]}
    assert told(prefix_trie.conversation_trie(frame)) == brute_trie(convs)
    assert prefix_trie.conversation_trie(frame.where("false")).count() == 0
    lone = spark.createDataFrame([(7, [])], "conv_id long, turns array<struct<digest: binary, words: long>>")
    assert told(prefix_trie.sequence_trie(lone)) == brute_trie({7: []})


def test_ids_of_many_equal_conversations_are_told_in_order(spark):
    """Ids go in chunks of 256, so 3,000 equal conversations have a dozen of them."""
    same = spark.range(3000).select((F.col("id") * 7 - 900).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    got = {r.depth: r for r in prefix_trie.conversation_trie(same.repartition(7)).collect()}
    told = ",".join(str(i * 7 - 900) for i in range(3000))
    assert got[1].ends_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[1].n_convs == 3000 and got[0].n_leaves == 1


# --- alignment -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coders():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(texts, coders):
    """Byte by byte: the tokens that cover each byte, as sets."""
    a, b = coders
    back = {c: x for x, c in enumerate(map_of_bytes())}
    each = []
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        data_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        data_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or not b"".join(data_a) == b"".join(data_b) == (" " + text).encode():
            each.append(None)
            continue
        over_a, over_b = ([k for k, d in enumerate(data) for _ in d] for data in (data_a, data_b))
        links = sorted(set(zip(over_a, over_b)))
        ends_a, ends_b = ({sum(map(len, data[: k + 1])) for k in range(len(data))} for data in (data_a, data_b))
        groups, start = [], 0
        for end in sorted(ends_a & ends_b):
            own = [sorted(set(over[start:end])) for over in (over_a, over_b)]
            groups.append("|".join(",".join(str(ids[k]) for k in ks) for ks, ids in zip(own, (ids_a, ids_b))))
            start = end
        each.append((len(ids_a), len(ids_b), groups, [(ids_a[x], ids_b[y]) for x, y in links]))
    counts = Counter(p for e in each if e for p in e[3])
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for e in each:
        if e is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(counts[p] == top[p[1]] for p in e[3])
            out.append((e[0], e[1], len(e[2]), len(e[3]), best, sum(counts[p] for p in e[3]), hashlib.sha256(";".join(e[2]).encode()).hexdigest()))
    return out


def map_of_bytes():
    """The characters of bytes 0 to 255, as the vocabulary's library has them."""
    order = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    chars = {b: chr(b) for b in order}
    for n, b in enumerate(b for b in range(256) if b not in order):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


ODD = [
    " leading space", "  two", "trailing ", "trail  ", " ", "   ", "\n", "\n x", "a\n b", "tab\there  and  there", "▁under", "x▁y z", "<s> </s> <unk> <0x41>", "<|endoftext|> and",
    "Ünïcödé ẞ 漢字 仮名 \U0001f600\U0001f468‍\U0001f469 é", "\x00 \x01", "ﬁ Ａ ½    x", "don't we'll  I'm", "1234567 89", "a" * 3000, "multi\r\n\r\n  lines\t\t end", "﻿bom", "ÃÂ",
]


def scored(frame, **more):
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")
    aligned = alignment.align_tokens(frame, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    assert aligned.where(F.size(alignment.group_arrays(F.col("groups"))) != F.col("n_groups")).isEmpty()
    done = alignment.score_links(aligned.withColumn("sha", sha).drop("groups"), **more)
    return done, lambda rows: Counter((r.doc_id, *(r[c] for c in cols)) for r in rows)


@pytest.mark.parametrize("pairs", [10**6, 0])
def test_alignment_of_odd_texts(spark, coders, pairs):
    rows = [*AWKWARD, *((100 + i, t, "s", "en") for i, t in enumerate(ODD))]
    rows = [(r[0], r[1][:20_000] if r[1] else r[1], *r[2:]) for r in rows]
    done, told = scored(docs(spark, rows).repartition(3), pairs=pairs)
    got = done.collect()
    assert told(got) == Counter((r[0], *w) for r, w in zip(rows, brute_alignment([r[1] for r in rows], coders)))
    assert all(r["KEPT"] == "mine" and r["size"] == "mine" for r in got)


def test_alignment_query_matches_brute_force(spark, sf, coders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((i, *w) for (i, _), w in zip(rows, brute_alignment([t for _, t in rows], coders)))
    got = Q.op12_align_tokenizers(spark, sf).collect()
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in cols) for r in got) == want


def test_alignment_of_nothing_and_of_forgotten_chunks(spark, coders, monkeypatch):
    empty, _ = scored(docs(spark, []))
    assert empty.count() == 0
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        pair = alignment.Pair(f.read(), g.read())
    monkeypatch.setattr(alignment, "MEMO", 40)
    texts = [f"word{i} and other{i % 7} words" for i in range(60)] + ODD
    want = [(w[0], w[1], w[2], w[6]) for w in brute_alignment(texts, coders)]
    sha = lambda told, n: hashlib.sha256(told.encode()).hexdigest() if n else ""
    for _ in range(2):
        rows = [[x[0].as_py() for x in pair.align([t])[:4]] for t in texts]
        assert [(*r[:3], sha(r[3], r[0])) for r in rows] == want and len(pair.row) < 80


def test_groups_as_arrays(spark):
    got = spark.createDataFrame([("1,2|3;4|5,6",), ("",)], "g string").select(alignment.group_arrays(F.col("g")).alias("x")).collect()
    assert [[(list(g.a), list(g.b)) for g in r.x] for r in got] == [[([1, 2], [3]), ([4], [5, 6])], []]


def test_a_piece_with_a_space_inside_needs_whole_texts(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        pair = alignment.Pair(f.read(), g.read())
    assert pair.by_chunk
    whole = [x.to_pylist() for x in pair.align(ODD)]
    pair.by_chunk, pair.row = False, {}
    assert [x.to_pylist() for x in pair.align(ODD)] == whole


# --- main text of pages ----------------------------------------------------------------------------------------------


def plain_reading(source):
    """The article of the table's own template, by patterns."""
    found = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", source or "")
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", found[1]))).split()) if found else ""


def test_pages_of_the_table(spark, sf):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.op13_html_extract(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id][0] and r.text == plain_reading(pages[r.page_id][1]) and r.n_chars == len(r.text)


def page_text(source):
    page = html_extract.Page(source)
    return page.told([page.best()])


BODY = "This is a long enough paragraph of the article, with words in it. " * 4
CASES = {
    "classes": f'<body><div id="top" class="site-header">Brand <a href="/">Home</a></div><div class="menu">One Two Three</div><div class="layout has-sidebar"><div class="post-12 entry"><h1>Title</h1><p>{BODY}</p>'
    f'<div class="ad-slot">Buy this now</div><p>{BODY}</p><form><label>Name</label><input><button>Send</button></form></div><div class="sidebar"><p>{BODY}</p></div></div><div id="footer">Copyright</div>',
    "article": f'<header><h1>Site</h1></header><nav><ul><li><a href="x">a</a></ul></nav><main><article><header><h1>Title</h1><p>By someone</p></header><p>{BODY}<p>{BODY}<aside>Also read this</aside>'
    f'<footer>Posted in x</footer></article><section id="comments"><article class="comment"><p>{BODY * 9}</p></article></section></main><footer>c</footer>',
    "comments inside": f'<article><h1>Title</h1><p>{BODY}</p><p>{BODY}</p><div class="comments"><p>Nice! {BODY * 5}</p></div><ol class="commentlist"><li>First</li></ol></article>',
    "table layout": f'<table><tr><td><a href="a">x</a> <a href="b">y</a><td><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></td></tr></table>',
    "sections": f'<body><div class="cookie-consent">We use cookies</div><article><section><h1>Title</h1><p>{BODY}</p></section><section><p>{BODY}</section></article>',
    "hidden": f'<article><h1>Title</h1><p hidden>no</p><p style="color:red; display: none">no</p><p>{BODY}</p><noscript>no</noscript><p>{BODY}<template>no</template></article>',
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_parts_that_are_no_article(name):
    assert page_text(CASES[name]) == " ".join(["Title", BODY.strip(), BODY.strip()])


def test_markup():
    read = lambda inner: page_text(f"<article>{inner}</article>")
    assert read("<p>a<b>b</b>c<br>d</p><ul><li>e<li>f</ul>g") == "abc d e f g"
    assert read("<p>x &amp; y &lt;b&gt; &eacute;&#233;&#xe9; &nbsp; z &unknown; &amp;amp;</p>") == "x & y <b> ééé z &unknown; &amp;"
    assert read("a<!-- <p>no</p> -->b<!-->c<script>var t='</p><p>no';</script>d<style>p{}</style>e") == "abcde"
    assert read("<p title='a>b' data-x=\"</p>\" class=it's>text < 5 & 6 > 3 <3</p>") == "text < 5 & 6 > 3 <3"
    assert read("<p>one<p>two<div>three</div>four<table><tr><td>a<td>b<tr><td>c</table>") == "one two three four a b c"
    assert read("<p>\n\t a \r\n b c </p>") == "a b c"
    assert page_text("plain words only") == "plain words only" and page_text("") == "" and page_text("<article></article>") == ""
    assert page_text("<article><p>cut off <b>here") == "cut off here"
    assert page_text("<p unclosed='") == "" and page_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_paths_that_the_host_agrees_on(spark):
    """Short articles beside longer notes, in containers that no name gives away, are found by the pages that are clear."""
    page = lambda body, note: f'<div class="x1"><a href="a">menu</a></div><div class="x2 p-{100 + len(body)}"><p>{body}</p></div><div class="x3"><p>{note}</p></div>'
    rows = [(i, f"http://Host.example/{i}", page(BODY * (1 + i % 3), "a note")) for i in range(12)] + [(90, "https://host.example", page("Ti.", "a much longer note of many words")), (91, None, page("Ti.", BODY))]
    rows += [(92, "nonsense", None), (93, "http://host.example/odd", "<section><h1>Odd</h1><p>page</p></section>"), (94, "http://host.example/none", ""), (95, None, None), (95, None, None)]
    frame = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "page_id long, url string, html string, HOST string, Main_Text string")
    won = html_extract.host_paths(frame).collect()
    assert [(r.host, r.path, r.votes, r.place) for r in sorted(won, key=lambda r: r.place)][0] == ("host.example", "body/div.p-0.x2", 12, 1)
    for hosts in (100, 0):
        got = {r.page_id: r for r in html_extract.extract_pages(frame, hosts=hosts).collect()}
        assert got[90].main_text == "Ti." and got[90].by_host and got[3].main_text == BODY.strip() and got[90].HOST == "mine"
        assert not got[91].by_host and got[92].main_text == "" and got[94].main_text == "" and got[93].main_text == "Odd page" and got[95].main_path == "body"
    assert html_extract.extract_pages(frame).count() == len(rows) and html_extract.extract_pages(frame.where("false")).count() == 0
