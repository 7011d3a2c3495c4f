"""What the operators of this subpackage share; durable intermediate tables come from the library's workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.batches import bound_batches, lean_worker
from millrace.sources.workspace import discard, fresh_path, materialize, settled, workspace

__all__ = ["BROADCAST_ROWS", "bound_batches", "discard", "free_name", "fresh_path", "join_sized", "lean_worker", "materialize", "settled", "sized_broadcast", "workspace"]

#: Rows of a narrow key table that may be broadcast. Beyond it the join shuffles; results are the same.
BROADCAST_ROWS = 500_000


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow key table for broadcast if its counted rows are within the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Keys that are dealt out one by one, at most; rows of a key that always stay together.
HOT_KEYS, CHUNK = 50_000, 128


def join_sized(
    left: DataFrame,
    right: DataFrame,
    key: str | tuple[str, ...],
    size: str = "n",
    how: str = "inner",
    deal: Column | None = None,
    narrow: bool = False,
) -> DataFrame:
    """Joins ``left`` with a stored table of one row a key, whose column ``size`` has the key's rows in ``left``, at least.

    A key may hold any share of the rows. One of more than a 50,000th of them (CHUNK at least) is dealt out evenly in
    chunks of that size, and its row on the right goes to every chunk. So there are HOT_KEYS such keys at most, and
    their list is broadcast. Rows are dealt out by number, for which ``left`` has to come from a scan, or else by the hash
    ``deal``. The size is left out of the result. ``narrow`` says that the right has few bytes beside the left; a task
    then hashes its part of the right and sorts nothing.
    """
    on = [key] if isinstance(key, str) else list(key)
    total, largest = right.agg(F.sum(size), F.max(size)).first()
    most = max(CHUNK, (total or 0) // HOT_KEYS)
    if (largest or 0) <= most:
        return left.join(right.drop(size).hint("shuffle_hash") if narrow else right.drop(size), on, how)
    parts, part = free_name(left, "hot_parts"), free_name(left, "hot_part")
    many = F.ceil(F.col(size) / most).cast("int")
    hot = F.broadcast(materialize(right.where(F.col(size) > most).select(*on, many.alias(parts)), "hot-keys"))
    number = F.monotonically_increasing_id() if deal is None else deal
    dealt = F.pmod(number, F.coalesce(parts, F.lit(1)).cast("long")).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col(size) > most, many).otherwise(1) - 1))
    spread = left.join(hot, on, "left").withColumn(part, dealt).drop(parts)
    right = right.withColumn(part, copies).drop(size)
    return spread.join(right.hint("shuffle_hash") if narrow else right, [*on, part], how).drop(part)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that none of the frame's columns has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
