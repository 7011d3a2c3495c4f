"""Chat formatting with a grammar round trip. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: Escaped content has every ESCAPE doubled and one after the first character of every control string.
ESCAPE = "\\"
CONTROLS = (OPEN, CLOSE, END)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: doubled escapes come in pairs, so a single one after ``[`` or ``<`` marks a control string."""
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(c[0] + ESCAPE + c[1:]), F.lit(c))
    return F.replace(out, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text>>; null where a turn breaks the grammar.

    A control string inside a role or a text breaks it.
    """
    pieces = F.split(rendered, rf"\Q{END}\E")
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        close = F.instr(piece, CLOSE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), close - len(OPEN) - 1)
        text = F.substring(piece, close + len(CLOSE), F.length(piece))
        fits = piece.startswith(OPEN) & (close > len(OPEN))
        for c in CONTROLS:
            fits = fits & ~role.contains(c) & ~text.contains(c)
        return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.when(F.element_at(pieces, -1) == "", F.transform(turns, turn))


def format_chat(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row a conversation: id, ``formatted``, ``segments``, ``turns`` (parsed back) and ``identical``.

    Content is first rendered as it stands and the result parsed again. Where the recovered turns differ from the
    source (a text holds a control string or the escape mark) the conversation is rendered with escaped content and
    parsed once more; escaping is one to one and leaves no control string, so that ends the loop. ``identical`` says
    that the turns read from ``formatted`` are the source's. ``segments`` cuts ``formatted`` into array<struct<piece,
    loss>>: loss is true for the texts of ``loss_role`` and nothing else, and the pieces join to ``formatted``.

    Cases: null texts and roles count as empty. Turns that share a number, or have none, go by role, then text; null
    numbers come first. Rows that repeat are turns of their own. Null ids form one conversation. An empty table gives
    an empty result. Other columns are ignored; where the id has the name of a column here, that column's begins with ``_``. A conversation is one value and so is gathered in one task.
    """
    blank = F.lit("")
    row = F.struct(
        F.col(turn_col).alias("at"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text")
    )
    # Below, every column has a name of this function's own; the id gets its name back at the end.
    source = turns.select(F.col(conv_col).alias("conv"), row.alias("row")).groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    source = source.withColumn("source", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))))
    plain = F.array_join(F.transform("source", lambda t: _turn(t["role"], t["text"])), "")
    escaped = F.transform("source", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    checked = source.withColumn("plain", plain).withColumn("safe", F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    body = checked.withColumn("body", F.when(F.col("safe"), F.col("source")).otherwise(escaped)).withColumn(
        "formatted",
        F.when(F.col("safe"), F.col("plain")).otherwise(F.array_join(F.transform("body", lambda t: _turn(t["role"], t["text"])), "")),
    )
    no, segment = F.lit(False), lambda piece, loss: F.struct(piece.alias("piece"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "body",
            lambda t: F.array(
                segment(F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE)), no),
                segment(t["text"], unescape(t["role"]) == loss_role),
                segment(F.lit(END), no),
            ),
        )
    )
    read = body.withColumns({"segments": segments, "turns": parse(F.col("formatted"))})
    identical = F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("identical")
    made = read.select("conv", "formatted", "segments", "turns", identical)
    return made.toDF(conv_col, *[f"_{n}" if n == conv_col.lower() else n for n in made.columns[1:]])


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
