"""Joins that stay balanced although a few keys own most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys are treated as hot. Every key with at least 1/HOT_KEYS of all rows is among them.
HOT_KEYS = 1000


def hottest(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The at most HOT_KEYS keys with the greatest counts (ties by key): a frame of proven size."""
    return counts.orderBy(F.desc(n), F.asc(key)).limit(HOT_KEYS).select(key)


def spread_join(facts: DataFrame, dims: DataFrame, key: str, counts: DataFrame, n: str, how: str = "inner") -> DataFrame:
    """``facts`` join ``dims`` (one row per key) on ``key``, exact, without one task getting a hot key's facts.

    ``counts`` has the number of facts per key in ``n``. The dimension rows of the hottest keys, at most HOT_KEYS, are
    broadcast; the facts of all other keys, each with less than 1/HOT_KEYS of the rows, are shuffled. Null keys match
    nothing: they are lost with ``how='inner'`` and kept with ``how='left'``.
    """
    cols = [c for c in dims.columns if c != key]
    hot = F.broadcast(dims.join(F.broadcast(hottest(counts, key, n)), key, "left_semi").select(key, F.struct(F.lit(1).alias("_is"), *cols).alias("_hot")))
    marked = facts.join(hot, key, "left")
    first = marked.where(F.col("_hot").isNotNull()).select(*facts.columns, *[F.col(f"_hot.{c}").alias(c) for c in cols])
    rest = marked.where(F.col("_hot").isNull()).select(*facts.columns)
    return first.unionByName(rest.join(dims, key, how).select(*facts.columns, *cols))
