"""What changed between full snapshots (problem 4): validity intervals by gaps and islands, and change events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.canonical import canonical_properties
from quarrygraph.operators.ranks import ranked

#: Snapshot numbers are read once and broadcast up to this many; beyond it they are joined by shuffle with salts.
MOST_SNAPSHOTS = 100_000
SALTS = 64
TOLERANCE = 1e-9


def _ranked(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Adds ``rank`` (1, 2, ... by snap_no), ``last`` (of the table's last snapshot) and ``next_snap``."""
    spark = rows.sparkSession
    kind = dict(snapshots.dtypes)["snap_no"]
    numbers = snapshots.select("snap_no").where("snap_no IS NOT NULL").distinct()
    found = sorted(r[0] for r in numbers.limit(MOST_SNAPSHOTS + 1).collect())
    if len(found) <= MOST_SNAPSHOTS:
        ranks = spark.createDataFrame([(n, i + 1, len(found), found[i + 1] if i + 1 < len(found) else None) for i, n in enumerate(found)], f"snap_no {kind}, rank int, last int, next_snap {kind}")
        return rows.join(F.broadcast(ranks), "snap_no")
    ranks = ranked(numbers, ["snap_no"]).withColumn("rank", F.col("rank").cast("int"))
    after = ranks.select((F.col("rank") - 1).alias("rank"), F.col("snap_no").alias("next_snap"))
    ranks = ranks.join(after, "rank", "left").withColumn("last", F.lit(numbers.count()).cast("int")).select("snap_no", "rank", "last", "next_snap")
    salted = ranks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["snap_no", "_salt"]).drop("_salt")


def _near(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) < TOLERANCE, F.lit(False))


def validity(snapshots: DataFrame, keys: Sequence[str], values: Sequence[str], json: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """(*keys, from_rank, to_rank, from_snap, gone_snap, last, before): maximal runs of consecutive snapshots in which a record is the same.

    ``gone_snap`` is the snapshot after the run (null at the table's end); ``before`` is the last rank of the run before
    it. Only a 64-bit hash of the values is shuffled, with the numbers, which count as the same if they differ by less
    than 1e-9. Null and '' are the same value; ``json`` columns are compared by content. Of a key that comes twice in a
    snapshot the row with the latest delivered_at counts, null first, ties by the greater hash. Rows without snap_no
    belong to no snapshot; null keys are compared as ''. An empty table gives no rows.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in values] + [canonical_properties(F.col(c)) for c in json]
    rows = snapshots.select("snap_no", *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys], "delivered_at", F.xxhash64(*text).alias("_hash"), *[F.col(c).alias(f"_n{i}") for i, c in enumerate(numbers)])
    nums = [f"_n{i}" for i in range(len(numbers))]
    best = rows.groupBy("snap_no", *keys).agg(F.max(F.struct("delivered_at", "_hash", *nums)).alias("_row"))
    seen = _ranked(best.select("snap_no", *keys, *[F.col(f"_row.{c}").alias(c) for c in ["_hash", *nums]]), snapshots)
    order = Window.partitionBy(*keys).orderBy("rank")
    same = [F.lag("_hash").over(order).eqNullSafe(F.col("_hash")), (F.lag("rank").over(order) == F.col("rank") - 1), *[_near(F.lag(c).over(order), F.col(c)) for c in nums]]
    starts = seen.withColumn("_start", F.when(F.coalesce(reduce(lambda x, y: x & y, same), F.lit(False)), 0).otherwise(1))
    island = starts.withColumn("_island", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = island.groupBy(*keys, "_island").agg(F.min("rank").alias("from_rank"), F.max("rank").alias("to_rank"), F.min("snap_no").alias("from_snap"), F.max(F.struct("rank", "next_snap"))["next_snap"].alias("gone_snap"), F.max("last").alias("last"))
    by_start = Window.partitionBy(*keys).orderBy("from_rank")
    return runs.select(*keys, "from_rank", "to_rank", "from_snap", "gone_snap", "last", F.lag("to_rank").over(by_start).alias("before"), F.lead("from_rank").over(by_start).alias("after"))


def change_events(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(snap_no, *keys, change): 'added', 'removed' and 'changed' from the intervals of ``validity``; the first snapshot gives none."""
    touches = F.coalesce(F.col("before") == F.col("from_rank") - 1, F.lit(False))
    start = F.when(F.col("from_rank") > 1, F.struct(F.col("from_snap").alias("snap_no"), F.when(touches, "changed").otherwise("added").alias("change")))
    follows = F.coalesce(F.col("after") == F.col("to_rank") + 1, F.lit(False))
    end = F.when((F.col("to_rank") < F.col("last")) & ~follows, F.struct(F.col("gone_snap").alias("snap_no"), F.lit("removed").alias("change")))
    return runs.select(*keys, F.explode(F.array(start, end)).alias("e")).where("e IS NOT NULL").select("e.snap_no", *keys, "e.change")


def entity_changes(snapshots: DataFrame) -> DataFrame:
    runs = validity(snapshots, ["entity_name"], ["entity_type", "description", "source_id"], json=["properties_json"])
    return change_events(runs, ["entity_name"]).select("snap_no", F.lit("entities").alias("tab"), F.col("entity_name").alias("key1"), F.lit("").alias("key2"), F.lit("").alias("key3"), "change")


def relation_changes(snapshots: DataFrame) -> DataFrame:
    keys = ["src_id", "tgt_id", "keywords"]
    runs = validity(snapshots, keys, ["resolution_qualifier", "source_id"], numbers=["weight"])
    return change_events(runs, keys).select("snap_no", F.lit("relations").alias("tab"), F.col("src_id").alias("key1"), F.col("tgt_id").alias("key2"), F.col("keywords").alias("key3"), "change")
