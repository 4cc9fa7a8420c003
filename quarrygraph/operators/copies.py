"""Differences between two copies of a dataset (problem 5), field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.canonical import compared

TOLERANCE = 1e-9


def _differs(field: str, kind: str) -> Column:
    a, b = F.col(f"main.{field}"), F.col(f"mirror.{field}")
    if kind in ("double", "float"):
        return ~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) < TOLERANCE, F.lit(False)))
    if kind == "string":
        return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))
    return ~a.eqNullSafe(b)


def copy_differences(main: DataFrame, mirror: DataFrame, key: str, fields: Sequence[str], json_field: str | None = None, by: str = "indexed_at") -> DataFrame:
    """(rec_key, field, diff): keys on one side only ('only_main', 'only_mirror', field '') and each field that 'differs'.

    Both sides are tagged, unioned and grouped once by ``key`` into one mergeable struct per side, the row with the
    latest ``by`` (null first; ties by the greatest values), so a key delivered very often collapses before the shuffle.
    Null and '' are the same; doubles are if they differ by less than 1e-9; ``json_field`` is compared by content and
    reported per top-level property. Rows with a null key are no records. Other columns than the named are ignored.
    """
    kinds = dict(main.dtypes)
    cols = [by, *fields, *([json_field] if json_field else [])]
    tag = lambda df, side: df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lit(side).alias("_side"), F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in cols]).alias("_row"))
    one = lambda side: F.max(F.when(F.col("_side") == side, F.col("_row")))
    both = tag(main, 0).unionByName(tag(mirror, 1)).groupBy("_key").agg(one(0).alias("main"), one(1).alias("mirror"))
    names: Column = F.filter(F.array(*[F.when(_differs(c, kinds[c]), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    if json_field:
        a, b = F.col(f"main.{json_field}"), F.col(f"mirror.{json_field}")
        met = F.col("main").isNotNull() & F.col("mirror").isNotNull()
        both = compared(both, F.when(met, a), F.when(met, b), "_json", json_field)
        names = F.concat(names, F.col("_json"))
    side = F.when(F.col("mirror").isNull(), "only_main").when(F.col("main").isNull(), "only_mirror").otherwise("differs")
    out = both.select(F.col("_key").cast("string").alias("rec_key"), side.alias("diff"), F.when(side == "differs", names).otherwise(F.array(F.lit(""))).alias("_fields"))
    return out.select("rec_key", F.explode("_fields").alias("field"), "diff")


def entity_differences(main: DataFrame, mirror: DataFrame) -> DataFrame:
    return copy_differences(main, mirror, "entity_name", ["entity_type", "description", "source_id"], "properties_json").select(F.lit("entities").alias("tab"), "rec_key", "field", "diff")


def relation_differences(main: DataFrame, mirror: DataFrame) -> DataFrame:
    return copy_differences(main, mirror, "ord", ["src_id", "tgt_id", "keywords", "source_id", "weight", "resolution_qualifier"]).select(F.lit("relations").alias("tab"), "rec_key", "field", "diff")
