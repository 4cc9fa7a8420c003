"""One counted row per key: the latest delivery wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, keys: Sequence[str], by: str, cols: Sequence[str]) -> DataFrame:
    """The row with the greatest ``by`` of each key, as ``keys``, ``by`` and ``cols``; other columns are dropped.

    Aggregates with a mergeable ``max(struct)``, so repeated deliveries of a hot key collapse before the shuffle.
    A null ``by`` counts as the earliest; among rows with equal ``by`` the greatest values of ``cols`` win, in that
    order; rows in which every key is null belong to no record and are left out. An empty table gives an empty result.
    """
    rest = [by, *cols]
    row = F.max(F.struct(*[F.col(c) for c in rest])).alias("_row")
    some: Column = F.lit(False)
    for k in keys:
        some = some | F.col(k).isNotNull()
    return df.where(some).select(*keys, *rest).groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
