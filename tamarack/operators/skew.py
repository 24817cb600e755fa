"""Joins with a table of one row per key that hold up when a key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.session import materialise

#: Rows of a key from which it counts as hot, and rows up to which a table of keys is broadcast.
HOT, BROADCAST_ROWS = 50_000, 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written and counted, with a broadcast hint if it has at most ``rows`` rows."""
    df = materialise(df, "bounded")
    return F.broadcast(df) if df.count() <= rows else df


def lookup(left: DataFrame, right: DataFrame, keys: list[str], count: str, hot: int | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and the number of left rows of it in ``count``.

    Keys of more than ``hot`` rows, of which there are at most the left rows over ``hot``, are looked up where the left
    rows lie; only rows of other keys are shuffled. ``count`` is dropped. Null keys meet nothing; without rows on
    either side the result is empty. Columns of both sides other than the keys need different names.
    """
    right, hot = materialise(right, "lookup"), HOT if hot is None else hot
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(count)), keys)
    many = bounded(right.where(F.col(count) > hot).drop(count))
    rest = left.join(many.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= hot).drop(count), keys)
    return left.join(many, keys).unionByName(rest)
