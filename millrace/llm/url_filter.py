"""URL filter: rules, and where none fits, naive Bayes over segmented hosts and path tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import free_name, join_sized, materialize

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Letters of a word at most when a name is split: the longest label that a host name can have (RFC 1035).
LONGEST_WORD = 63
#: Log odds are added as whole numbers of this part of 1, so that sums do not depend on their order.
FINE = 10**9
#: Runs of letters or of digits.
_LETTERS, _RUNS = r"\p{L}+", r"\p{L}+|\p{Nd}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and others."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    found = F.lit(None)
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A stored table (word, n): all words of the visible text of all pages, lower-cased; URLs in the text count no words."""
    shown = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"<[^>]*>|[A-Za-z][A-Za-z0-9+.-]*://\S*", " "))
    words = pages.select(F.explode(F.split(shown, r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return materialize(words.groupBy("word").agg(F.count("*").alias("n")), "unigrams")


def best_split(name: str, counts: Mapping[str, int], total: int) -> list[str]:
    """The split of largest probability under independent words (Viterbi). counts: of the words that occur in the name.

    The name itself counts as an unknown word: that a host is called so is no sign that it is one word. Unknown words
    cost more by a factor of ten a letter.
    """
    log_total, log_ten = math.log(total + 1), math.log(10)
    known = {w: log_total - math.log(n) for w, n in counts.items() if w != name}
    best, start = [0.0], [0]
    for end in range(1, len(name) + 1):
        found = ((best[i] + known.get(name[i:end], log_total + log_ten * (end - i - 1)), i) for i in range(max(0, end - LONGEST_WORD), end))
        cost, at = min(found)
        best.append(cost)
        start.append(at)
    words, end = [], len(name)
    while end:
        words.append(name[start[end] : end])
        end = start[end]
    return words[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """From names (name) and words (word, n) to a stored table (name, words). Every part of a name is looked up in all words.

    A name of L letters has LONGEST_WORD * L parts at most; parts meet the word table by key, and only the counts of
    those that are words go on to the split.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    size = F.length("name")
    starts = names.distinct().select("name", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - F.col("at") + 1)))
    parts = starts.select("name", "at", sizes.alias("size")).select("name", F.expr("substring(name, at, size)").alias("word")).distinct()
    parts = materialize(parts, "name-parts")
    known = parts.groupBy("word").agg(F.count("*").alias("names")).join(words, "word").select("word", "names", "n")
    held = join_sized(parts, materialize(known, "name-words"), "word", size="names")
    held = held.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_split(n, {h["word"]: h["n"] for h in held or ()}, total) for n, held in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["name", "words"])

    return materialize(names.distinct().join(held, "name", "left").select("name", "held").mapInArrow(run, "name string, words array<string>"), "name-splits")


def _told(kind: str, run: Column) -> Column:
    """A token: a word with the place it stands in, or the length of a number."""
    return F.when(run.rlike(r"^\p{Nd}"), F.concat(F.lit(f"{kind}#"), F.length(run).cast("string"))).otherwise(F.concat(F.lit(f"{kind}:"), run))


def with_tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``tokens`` to a stored table with host and path: the words of the host's names, then those of the path."""
    hosts = materialize(urls.groupBy("host").agg(F.count("*").alias("n")), "url-hosts")
    runs = materialize(hosts.select("host", F.posexplode(F.regexp_extract_all(F.lower("host"), F.lit(_RUNS), F.lit(0))).alias("at", "name")), "url-names")
    names = runs.groupBy("name").agg(F.count("*").alias("n")).where(F.col("name").rlike(r"^\p{L}"))
    splits = materialize(names.join(segmented(names.select("name"), words), "name"), "url-names")
    split = join_sized(runs, splits, "name", how="left").select("host", "at", F.coalesce("words", F.array("name")).alias("words"))
    split = split.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    of_host = hosts.join(split, "host", "left").select("host", "n", F.transform("words", lambda w: _told("h", w)).alias("host_tokens"))
    path = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(_RUNS), F.lit(0)), lambda w: _told("p", w))
    met = join_sized(urls, materialize(of_host, "url-host-tokens"), "host")
    none = F.array().cast("array<string>")
    return met.withColumn("tokens", F.concat(F.coalesce("host_tokens", none), path)).drop("host_tokens")


def fit_bayes(labelled: DataFrame) -> tuple[DataFrame, int, int]:
    """From (tokens, verdict, n) to a stored table (token, odds), the odds of a token that it lacks, and the prior odds.

    Multinomial naive Bayes with add-one smoothing over the tokens of all labelled rows, each as often as n says. Odds
    are log odds of block over allow in parts of 1 / FINE.
    """
    each = labelled.select(F.explode("tokens").alias("token"), "verdict", "n")
    sums = lambda df: [F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("block", "allow")]
    counts = materialize(each.groupBy("token").agg(*sums(each)), "url-counts")
    rows, all_tokens = labelled.agg(*sums(labelled)).first(), counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    block, allow, kinds = (x or 0 for x in all_tokens)
    unseen = math.log((allow + kinds + 1) / (block + kinds + 1))
    odds = F.round((F.log(F.col("block") + 1.0) - F.log(F.col("allow") + 1.0) + unseen) * FINE).cast("long")
    prior = math.log((rows.block + 1) / (rows.allow + 1))
    return materialize(counts.select("token", odds.alias("odds")), "url-odds"), round(unseen * FINE), round(prior * FINE)


def score_urls(urls: DataFrame, model: tuple[DataFrame, int, int]) -> DataFrame:
    """From (host, path, tokens) to (host, path, block_odds), one row a host and path."""
    odds, unseen, prior = model
    each = materialize(urls.select("host", "path", F.explode_outer("tokens").alias("token")), "url-tokens")
    own = each.groupBy("token").agg(F.count("*").alias("n")).join(odds, "token", "left")
    own = materialize(own.select("token", "n", F.coalesce("odds", F.lit(unseen)).alias("odds")), "url-token-odds")
    total = join_sized(each, own, "token", how="left").groupBy("host", "path").agg(F.coalesce(F.sum("odds"), F.lit(0)).alias("odds"))
    return total.select("host", "path", ((F.col("odds") + prior) / F.lit(float(FINE))).alias("block_odds"))


def judge_urls(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and ``block_odds`` (log odds; null where a rule decides).

    The longest rule that fits decides. For the others the pages that rules decide are the training rows, all of
    them. Names in hosts are split into words by a unigram model of all words of the pages' text, whatever their
    length or number, and multinomial naive Bayes scores the words of host and path; a number counts by its length.
    Odds of 0 or less allow. Distinct URLs are scored once; frequent hosts, names, tokens and URLs are dealt out.

    Cases: a null url, or one without ``://``, has empty host and path, no rule, and the prior's verdict; without
    training rows all are allowed. Null html adds no words. Ties in length cannot both fit unless rules repeat; then
    the later one in the list wins. Of equally likely splits the one whose last word is longest wins. Input columns with these names are
    replaced; other columns, repeated rows and empty tables pass as they are.
    """
    added = ("host", "path", "rule", "verdict", "block_odds")
    kept = pages.drop(*added)
    split = kept.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    found = free_name(kept, "found_rule")
    decided = split.withColumn(found, matching_rule(F.col("host"), F.col("path"), rules))
    decided = decided.withColumns({"rule": F.col(f"{found}.rule"), "verdict": F.col(f"{found}.verdict")}).drop(found)
    urls = materialize(decided.groupBy("host", "path", "verdict").agg(F.count("*").alias("n")), "urls")
    told = materialize(with_tokens(urls.withColumnRenamed("n", "pages"), unigrams(pages, html_col)).withColumnRenamed("pages", "n"), "url-tokens")
    open_urls = told.where("verdict is null")
    scores = score_urls(open_urls, fit_bayes(told.where("verdict is not null")))
    key = free_name(kept, "url_key")
    at = F.struct("host", "path")
    scores = open_urls.select("host", "path", "n").join(scores, ["host", "path"]).select(at.alias(key), "n", "block_odds")
    deal = F.xxhash64(*[f.name for f in kept.schema.fields if isinstance(f.dataType, T.AtomicType)])
    rest = join_sized(decided.where("verdict is null").withColumn(key, at), materialize(scores, "url-scores"), key, deal=deal)
    rest = rest.withColumn("verdict", F.when(F.col("block_odds") > 0, "block").otherwise("allow")).drop(key)
    done = decided.where("verdict is not null").withColumn("block_odds", F.lit(None).cast("double"))
    return done.unionByName(rest).select(*kept.columns, *added)
