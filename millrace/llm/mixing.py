"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import join_sized, materialize

#: White space of the word rule, as a character class and as the characters to trim.
SPACE_CLASS, SPACE_CHARS = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\x0c\r"
#: Each histogram has 2**BITS buckets a source; LEVELS of them resolve BITS * LEVELS bits of the hash.
BITS, LEVELS = 12, 4
#: Sources whose table of a row a source is broadcast. Beyond it rows meet it by key, large sources dealt out.
SOURCES = 100_000
#: Rows of one id and text that a task numbers at a time.
EQUAL = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts as 0."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS))).cast("long")


def mixture_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to a table with the columns source and source_size.

    Sources in code point order, null last, have the weights in turn and share ``share`` of all sizes; a target stops
    at ``most`` times its source's size and the excess goes to the others by weight until none is above. That fixed
    point is where the level ``x`` (target = weight * x) fills what the stopped sources leave, and sources stop in the
    order of most * size / weight; running sums over that order find it. One row a source goes through one task.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    ranked = totals.withColumn("w", weight).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by_stop = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns(
        {
            "left": F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(by_stop), F.lit(0.0)),
            "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_stop), F.lit(0.0)),
        }
    ).withColumn("x", F.col("left") / F.col("w_left"))
    # Until the first source that does not stop, every source stops; from there on all have its level.
    level = F.min(F.when(F.col("w") * F.col("x") <= F.col("stop"), F.struct(F.col("stop") / F.col("w"), "source", "x"))).over(every)["x"]
    return filled.withColumn("level", level).withColumn(
        "target", F.least(F.col("stop"), F.coalesce(F.col("w") * F.col("level"), F.col("stop")))
    ).select(*totals.columns, "target")


def _by_source(left: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins rows by ``mix_key`` with a stored table of one row a source, whose column n has the source's rows."""
    if sources.limit(SOURCES + 1).count() <= SOURCES:
        return left.join(F.broadcast(sources.drop("n")), "mix_key")
    return join_sized(left, sources, "mix_key", deal=F.col("mix_hash"))


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Adds ``size`` (words), ``mix_hash`` (of id and text) and ``mix_key``, the source in a form that is never null.

    Cases: null texts and texts of white space have size 0. Columns of these names that the input has are replaced.
    """
    space = 1 << (BITS * LEVELS)
    return docs.withColumns(
        {
            "size": word_count(F.col(text_col)),
            "mix_hash": F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.lit(space)),
            "mix_key": F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name")),
        }
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies * size) to every row.

    Copies are whole, so ``most`` is a whole number: the copies of a document at most, and where its source's target stops.
    Sizes and hashes are written once; only they are read for the histograms, see ``mix_rows``.

    Cases: null texts and texts of white space have size 0; null is a source of its own, after all others; rows that
    repeat id and text go one by one where a source's target falls among them; an empty table gives an empty result; a source of no words has
    target 0. Input columns with the names added here are replaced, other columns are carried along.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    own = F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("mix_row")
    rows = sized_rows(docs.select(own), f"mix_row.{_quoted(id_col)}", f"mix_row.{_quoted(text_col)}", f"mix_row.{_quoted(source_col)}")
    kept = [c for c in docs.columns if c.lower() not in added]
    return mix_rows(rows, weights, share, most).select(*[F.col("mix_row")[c].alias(c) for c in kept], *added)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mix_rows(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` to rows that ``sized_rows`` made.

    A source whose target is k whole passes and a remainder takes every document k times and those below a hash
    threshold once more. The threshold comes from a histogram of words by source and hash bucket: the bucket where the
    running sum crosses the remainder is opened again by the next bits, four times 12 bits, and only that bucket's
    rows are read for it. Nothing is sorted, and each histogram has at most 4,096 rows a source. The last bucket is
    one hash: a single row there is taken if that comes nearer to the target; of rows that repeat id and text, which are
    all there, as many as come nearest. The hash is of id and text, so reruns agree. Columns of whatever names are carried along.
    """
    if most < 1 or most != int(most):
        raise ValueError("a document is taken a whole number of times")
    space = 1 << (BITS * LEVELS)
    words = materialize(rows.select("mix_key", "mix_hash", "size"), "mix-words")
    totals = words.groupBy("mix_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    totals = totals.withColumn("source", F.when(~F.col("mix_key.none"), F.col("mix_key.name")))
    targets = mixture_targets(totals, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = targets.withColumn("passes", passes).withColumns(
        {"need": F.col("target") - F.col("passes") * F.col("source_size"), "floor": F.lit(0).cast("long"), "bucket_size": F.col("source_size"), "bucket_rows": F.col("n")}
    )
    edge = materialize(edge, "mix-edge")
    for step in range(1, LEVELS + 1):
        edge = materialize(_open_bucket(words, edge, space >> (BITS * step)), "mix-edge")
    # What is left is one hash value a source: take it if that is nearer to the target than leaving it, or some of its rows.
    several = F.col("bucket_rows") > 1
    some = F.round(F.try_divide(F.col("need") * F.col("bucket_rows"), F.col("bucket_size"))).cast("long")
    edge = edge.withColumns(
        {
            "threshold": F.col("floor") + (~several & (F.col("need") > F.col("bucket_size") / 2)).cast("long"),
            "some": F.when(several, F.least(F.coalesce(some, F.lit(0)), F.col("bucket_rows"))).otherwise(0),
        }
    )
    bound = materialize(edge.select("mix_key", "n", "source_size", "target", "passes", "threshold", "some", "bucket_rows"), "mix-bound")
    added = ("source_size", "target", "copies", "taken")
    carried = [c for c in rows.columns if c not in ("size", "mix_hash", "mix_key") and c.lower() not in added]
    packed = rows.select(F.struct(*[F.col(_quoted(c)) for c in carried]).alias("carried") if carried else F.lit(0).alias("carried"), "size", "mix_hash", "mix_key")
    met = _by_source(packed, bound)
    extra = (F.col("mix_hash") < F.col("threshold")).cast("long")
    if not bound.where("some > 0").isEmpty():
        extra = extra + F.col("one_more")
        met = _some_of_equal_rows(met)
    copies = F.least(F.col("passes") + extra, F.lit(int(most)).cast("long"))
    mixed = met.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    own = [c for c in rows.columns if c.lower() not in added]
    return mixed.select(*[(F.col("carried")[c] if c in carried else F.col(c)).alias(c) for c in own], *added)


def _some_of_equal_rows(met: DataFrame) -> DataFrame:
    """Adds ``one_more``, 1 for ``some`` of the rows whose hash is the threshold. Rows are dealt out in parts of about EQUAL."""
    at_edge = (F.col("mix_hash") == F.col("threshold")) & (F.col("some") > 0)
    parts = F.ceil(F.col("bucket_rows") / EQUAL).cast("long")
    own = Window.partitionBy("mix_key", "mix_part")
    dealt = met.where(at_edge).withColumn("mix_part", F.pmod(F.monotonically_increasing_id(), parts))
    number, size = F.row_number().over(own.orderBy("mix_hash")), F.count("*").over(own)
    picked = dealt.withColumn("one_more", (number <= F.round(size * F.col("some") / F.col("bucket_rows"))).cast("long")).drop("mix_part")
    return met.where(~at_edge).withColumn("one_more", F.lit(0).cast("long")).unionByName(picked)


def _open_bucket(words: DataFrame, edge: DataFrame, width: int) -> DataFrame:
    """Splits each source's boundary bucket into buckets of ``width`` hash values and keeps the one that crosses."""
    inside = _by_source(words, edge.select("mix_key", "n", "floor"))
    inside = inside.where((F.col("mix_hash") >= F.col("floor")) & (F.col("mix_hash") < F.col("floor") + (width << BITS)))
    start = (F.col("mix_hash") - F.col("mix_hash") % width).alias("start")
    histogram = inside.groupBy("mix_key", start).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    running = Window.partitionBy("mix_key").orderBy("start")
    summed = histogram.withColumn("before", F.sum("words").over(running) - F.col("words"))
    keep = ["mix_key", "n", "source_size", "target", "passes"]
    met = summed.join(edge.select("mix_key", "need"), "mix_key").where(F.col("before") <= F.col("need"))
    last = met.groupBy("mix_key").agg(F.max_by(F.struct("start", "words", "before", "rows"), "start").alias("b"))
    picked = edge.join(last, "mix_key", "left")
    return picked.select(
        *keep,
        (F.col("need") - F.coalesce(F.col("b.before"), F.lit(0))).alias("need"),
        F.coalesce(F.col("b.start"), F.col("floor")).alias("floor"),
        F.coalesce(F.col("b.words"), F.lit(0)).alias("bucket_size"),
        F.coalesce(F.col("b.rows"), F.lit(0)).alias("bucket_rows"),
    )
