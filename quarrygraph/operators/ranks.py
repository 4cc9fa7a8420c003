"""Numbering all rows in order without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.session import Scratch


def ranked(rows: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` as ``name``.

    The rows are range-partitioned and sorted, each task numbers its own, and the sizes of the parts before it are added:
    only one count per task is brought together. Rows that are equal in ``order`` get neighbouring places in any order.
    """
    work = Scratch(rows.sparkSession)
    # written first, as finding the ranges samples the rows, which would work them out twice
    rows = work.cut(rows)
    part = work.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.col("_part").cast("bigint") * (1 << 33)))
    sizes = part.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return part.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_at") + F.col("_before") + 1).alias(name))
