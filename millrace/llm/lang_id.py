"""Language ID by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import BROADCAST_ROWS, bound_batches, join_sized, lean_worker, materialize

#: Ranks of a profile, of a language and of a document.
PROFILE = 300
#: Longest n-gram.
ORDER = 3
#: Labelled rows of a language that its profile is fitted on, about: rows are drawn by a hash of their id.
FIT_ROWS = 4_000
#: Texts whose n-grams a worker holds at a time while profiles are fitted.
TEXTS = 64
#: Characters of a text that are counted at a time; whole texts are counted.
CHUNK = 1 << 20
UNKNOWN = "und"
_SPACE = 0x20


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one space, and a space at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_is_letter()[codes], codes, _SPACE)
    codes = np.concatenate([[_SPACE], codes, [_SPACE]]).astype(np.uint64)
    return codes[np.r_[True, (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)]]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to ORDER characters and their counts; 21 bits a character, first character lowest.

    N-grams that are only a space, or have one inside, are left out: an n-gram lies in one word with its ends marked.
    """
    codes = _letters(text)
    grams, counts = [], []
    for at in range(0, len(codes), CHUNK):
        part = codes[at : at + CHUNK + ORDER - 1]
        own = min(CHUNK, len(codes) - at)
        found = []
        for n in range(1, ORDER + 1):
            m = min(own, len(part) - n + 1)
            if m <= 0:
                continue
            gram = part[:m].copy()
            for k in range(1, n):
                gram |= part[k : m + k] << np.uint64(21 * k)
            inside = np.ones(m, dtype=bool) if n > 1 else part[:m] != _SPACE
            for k in range(1, n - 1):
                inside &= part[k : m + k] != _SPACE
            if n == 2:
                inside &= (part[:m] != _SPACE) | (part[1 : m + 1] != _SPACE)
            found.append(gram[inside])
        g, c = np.unique(np.concatenate(found), return_counts=True)
        grams.append(g)
        counts.append(c)
    if len(grams) == 1:
        return grams[0], counts[0]
    g, back = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def _ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller code."""
    if len(grams) > most:
        least = np.partition(counts, -most)[-most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:most]]


class Profiles:
    """Rank-order profiles of languages; ``predict`` gives the nearest language and how far it stands out.

    Only the ranks that there are are kept: a list of known n-grams, and for each the languages that rank it and where,
    at most PROFILE entries a language, 24 bytes each.
    """

    def __init__(self, ranked: Mapping[str, Sequence[int]]) -> None:
        self.langs = sorted(ranked)
        sizes = [len(ranked[lang]) for lang in self.langs]
        grams = np.concatenate([np.zeros(0, np.int64), *(np.asarray(ranked[lang], dtype=np.int64) for lang in self.langs)]).view(np.uint64)
        rank = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])
        by = np.argsort(grams, kind="stable")
        self.known, first = np.unique(grams[by], return_index=True)
        #: where the entries of a known n-gram begin, the end last; language and rank of an entry.
        self.start = np.r_[first, len(by)]
        self.lang, self.rank = np.repeat(np.arange(len(sizes)), sizes)[by].astype(np.int32), rank[by].astype(np.int32)

    def ranked(self) -> dict[str, list[int]]:
        """The n-grams of each language by rank."""
        gram = np.repeat(self.known, np.diff(self.start)).view(np.int64)
        by = np.lexsort((self.rank, self.lang))
        ends = np.searchsorted(self.lang[by], np.arange(len(self.langs) + 1))
        return {lang: gram[by[a:b]].tolist() for lang, a, b in zip(self.langs, ends, ends[1:])}

    def predict(self, text: str | None) -> tuple[str, float]:
        """The out-of-place distance sums, over the document's ranked n-grams, how far each lies from its rank in the
        language's profile, PROFILE for one that is absent. The score is 1 - distance / largest distance."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        grams = _ranked(*ngram_counts(text), PROFILE)
        if not len(grams):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == grams)
        begin, size = self.start[at[place]], self.start[at[place] + 1] - self.start[at[place]]
        ends = np.cumsum(size)
        entry = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        # All n-grams count PROFILE at first; an n-gram that a language ranks brings its distance down to that of the ranks.
        nearer = PROFILE - np.abs(self.rank[entry] - np.repeat(place, size))
        total = PROFILE * len(grams) - np.bincount(self.lang[entry], weights=nearer, minlength=len(self.langs)).astype(np.int64)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (PROFILE * len(grams)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, text) to (lang, gram, n), summed over TEXTS texts at a time."""
    lean_worker()
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            by_lang: dict[str, list] = {}
            for lang, text in zip(*whole.slice(at, TEXTS).columns):
                by_lang.setdefault(lang.as_py(), []).append(ngram_counts(text.as_py()))
            for lang, found in by_lang.items():
                g, back = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([x[1] for x in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def fit_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Profiles:
    """Profiles from labelled rows; rows without language or text are left out.

    A language of more than ``fit_rows`` rows is fitted on about that many, those whose hashed id falls below its
    share; that is the only sample. N-grams are counted in the tasks, summed by language and n-gram, and PROFILE of
    them a language come to the driver: they are the model, which grows with the languages and not with the rows.
    """
    bound_batches(labelled.sparkSession)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))
    rate = F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.count("*"))
    rates = materialize(rows.groupBy("lang").agg(rate.alias("rate"), F.count("*").alias("n")), "lang-rates")
    few = rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(rates.drop("n")), "lang") if few else join_sized(rows, rates, "lang", deal=F.xxhash64("draw"))
    drawn = met.where(F.col("draw") < F.col("rate")).select("lang", "text")
    summed = drawn.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = summed.withColumn("place", place).where(F.col("place") <= PROFILE)
    listed = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda g: g["gram"]).alias("grams")).toArrow()
    return Profiles({lang.as_py(): grams.values.to_numpy() for lang, grams in zip(listed.column("lang"), listed.column("grams"))})


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Adds the predicted language and a score from 0 to 1, from whole texts and nothing else.

    Cases: ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Equal distances go to
    the first language in code point order. Columns of the added names are replaced; other columns, repeated rows and
    empty tables pass as they are.
    """
    docs = docs.drop(lang_name, score_name)
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(at)]
            added = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, lang_name, score_name])

    fields = [*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(fields))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """Fits on the rows that are not held out, then predicts every row."""
    return identify(docs, fit_profiles(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **fit), text_col)
