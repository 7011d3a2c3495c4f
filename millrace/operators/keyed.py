"""Names that do not clash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def free_name(df: DataFrame, name: str, also: Iterable[str] = ()) -> str:
    """A column name that none of the frame's columns has, whatever its case, and none of ``also``."""
    taken = {c.lower() for c in [*df.columns, *also]}
    while name.lower() in taken:
        name = "_" + name
    return name
