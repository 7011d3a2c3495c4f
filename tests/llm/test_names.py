"""Operators that carry columns along do so whatever their names are: all names that the operator's own module writes are input columns."""

import re
from pathlib import Path

import public_tokenizers
import pytest

from millrace.llm import alignment, bpe, exact_dedup, html_extract, lang_id, mixing, simhash, substring_dedup, url_filter

FILE = "byte_bpe_multi_50k.tiktoken"
ROWS = [(i, f"word{i % 7} and some more words that follow here {i % 5}\n" * 3, f"http://h{i % 3}.org/{i}", f"s{i % 3}", ("en", "de")[i % 2]) for i in range(30)]
BASE = "doc_id long, text string, url string, source string, lang string"


def cut(docs):
    return substring_dedup.cut_passages(docs, substring_dedup.repeated_passages(docs))


def scored(docs):
    return alignment.score_links(alignment.align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


OPERATORS = {
    "exact_dedup": (exact_dedup, exact_dedup.exact_dedup),
    "keep_one": (simhash, simhash.keep_one),
    "cut_passages": (substring_dedup, cut),
    "mix_sources": (mixing, mixing.mix_sources),
    "identify": (lang_id, lang_id.learn_and_identify),
    "bpe_round_trip": (bpe, lambda d: bpe.bpe_round_trip(d, public_tokenizers.path(FILE), public_tokenizers.PATTERN)),
    "judge_urls": (url_filter, lambda d: url_filter.judge_urls(d, html_col="text")),
    "score_links": (alignment, scored),
    "extract_pages": (html_extract, lambda d: html_extract.extract_pages(d, html_col="text")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_with_an_operators_own_names(spark, name):
    module, run = OPERATORS[name]
    plain = spark.createDataFrame(ROWS, BASE)
    want = run(plain)
    own = {c.lower() for c in plain.columns}
    names = sorted({n.lower(): n for n in re.findall(r'"([A-Za-z_]\w*)"', Path(module.__file__).read_text())}.values())
    names = [n for n in names if n.lower() not in own]
    frame = plain.selectExpr("*", *[f"'mine' AS `{n}`" for n in names])
    got = run(frame)
    assert len(names) > 3 and set(want.columns) <= set(got.columns)
    order = lambda rows: sorted(map(str, rows))
    assert order(tuple(r[c] for c in want.columns) for r in got.collect()) == order(map(tuple, want.collect()))
    made = {c.lower() for c in want.columns} - own
    kept = [n for n in names if n in got.columns and n.lower() not in made]
    assert kept and all({r[n] for r in got.select(kept).collect()} <= {"mine"} for n in kept)
