"""Joins of many rows with one row per key, whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if more than this share of all rows has it; so fewer than this many are heavy.
HEAVY_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``left`` with ``right``, which has one row per key.

    ``weight`` is a column of ``right`` that counts the rows of ``left`` with its key, and is
    not kept. Rows of a heavy key meet their row, of which there are fewer than a thousand, where
    they lie; all others are joined as Spark sees fit. ``right`` should be written or cheap.
    """
    values = [name for name in right.columns if name not in (key, weight)]
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_heavy = F.col(weight) * HEAVY_SHARE > total
    heavy = right.filter(is_heavy).select(key, F.struct(*values).alias("_heavy"))
    if heavy.isEmpty():
        return left.join(right.drop(weight), key, "left").select(*left.columns, *values)
    marked = left.join(F.broadcast(heavy), key, "left")
    hot = marked.filter(F.col("_heavy").isNotNull()).select(*left.columns, "_heavy.*")
    others = right.filter(~is_heavy).drop(weight)
    rest = marked.filter(F.col("_heavy").isNull()).drop("_heavy").join(others, key, "left")
    return hot.unionByName(rest.select(*left.columns, *values))
