"""References to records that do not exist (problem 2).

Parents and children are unioned in one long, tagged form and grouped once by name; each name's group is a fixed-size
mergeable state, so names with a large share of the references cost one row per map task. Only groups without a sound
parent are kept, and the references are then looked up among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators.counted import counted
from quarrygraph.operators.joins import spread_join
from quarrygraph.session import Scratch

#: Texts that stand for no reference.
NO_REFERENCE = ["", "<unresolved>"]


def references(relations: DataFrame) -> DataFrame:
    """(ord, side, name, at): the checked endpoints of counted relations; targets only if resolved (or null)."""
    edges = counted(relations, ["ord"], "indexed_at", ["src_id", "tgt_id", "resolution_qualifier"])
    checked = F.coalesce("resolution_qualifier", F.lit("resolved")) == "resolved"
    ends = F.array(
        F.struct(F.lit("src").alias("side"), F.col("src_id").alias("name")),
        F.struct(F.lit("tgt").alias("side"), F.when(checked, F.col("tgt_id")).alias("name")),
    )
    return edges.select("ord", F.col("indexed_at").alias("at"), F.explode(ends).alias("e")).select("ord", "e.side", "e.name", "at").where(F.col("name").isNotNull() & ~F.col("name").isin(NO_REFERENCE))


def name_states(refs: DataFrame, entities: DataFrame, stubs: DataFrame) -> DataFrame:
    """(name, refs, first_ref, is_entity, is_stub, deleted, first_seen): one row per name that is referred to."""
    ts = dict(entities.dtypes)["indexed_at"]
    none = F.lit(None).cast(ts)
    cols = ["name", "n", "ref_at", "ent", "stub", "seen_at", "deleted_seen_at"]
    child = refs.select("name", F.lit(1).cast("bigint").alias("n"), F.col("at").cast(ts).alias("ref_at"), F.lit(0).alias("ent"), F.lit(0).alias("stub"), none.alias("seen_at"), none.alias("deleted_seen_at"))
    zero = F.lit(0).cast("bigint").alias("n")
    at = F.coalesce("indexed_at", F.lit("0001-01-01 00:00:00").cast(ts))
    parent = entities.where(F.col("entity_name").isNotNull()).select(
        F.col("entity_name").alias("name"), zero, none.alias("ref_at"), F.lit(1).alias("ent"), F.lit(0).alias("stub"), at.alias("seen_at"), F.when(F.col("deleted_at").isNotNull(), at).alias("deleted_seen_at")
    )
    stub = stubs.where(F.col("entity_name").isNotNull()).select(F.col("entity_name").alias("name"), zero, none.alias("ref_at"), F.lit(0).alias("ent"), F.lit(1).alias("stub"), none.alias("seen_at"), none.alias("deleted_seen_at"))
    grouped = (
        child.select(cols)
        .unionByName(parent.select(cols))
        .unionByName(stub.select(cols))
        .groupBy("name")
        .agg(F.sum("n").alias("refs"), F.min("ref_at").alias("first_ref"), F.max("ent").alias("is_entity"), F.max("stub").alias("is_stub"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.max("deleted_seen_at").alias("last_deleted"))
    )
    deleted = F.coalesce(F.col("last_deleted") == F.col("last_seen"), F.lit(False))
    return grouped.where("refs > 0").select("name", "refs", "first_ref", "is_entity", "is_stub", deleted.alias("deleted"), "first_seen")


def _refs_and_names(relations: DataFrame, entities: DataFrame, stubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references, and the names of ``name_states`` that one of them may fail to find. Each is written once, as each is read twice."""
    work = Scratch(relations.sparkSession)
    refs = work.cut(references(relations))
    states = name_states(refs, entities, stubs)
    return refs, work.cut(states.where((F.col("is_entity") + F.col("is_stub") == 0) | F.col("deleted") | (F.col("first_seen") > F.col("first_ref"))))


def broken_references(relations: DataFrame, entities: DataFrame, stubs: DataFrame) -> DataFrame:
    """(ord, side, name, at, state): every endpoint that leads to no record; state 'missing', 'deleted' or 'late'.

    'missing': in neither ``entities`` nor ``stubs``; else 'deleted': the entity's counted row (latest indexed_at; of
    equally late rows a deleted one) has a deleted_at; else 'late': the earliest indexed_at of the entity is later than
    the relation's. A relation or entity without indexed_at is never late. Null, empty and '<unresolved>' names are no
    references. Works on empty tables; columns other than the named ones are ignored.
    """
    refs, names = _refs_and_names(relations, entities, stubs)
    dims = names.select("name", "is_entity", "is_stub", "deleted", "first_seen")
    found = spread_join(refs, dims, "name", names, "refs")
    return found.select("ord", "side", "name", "at", _state(F.col("first_seen") > F.col("at")).alias("state")).where(F.col("state").isNotNull())


def _state(late: Column) -> Column:
    return F.when(F.col("is_entity") + F.col("is_stub") == 0, "missing").when(F.col("deleted"), "deleted").when(late, "late")


def broken_report(relations: DataFrame, entities: DataFrame, stubs: DataFrame, tab: str = "relations") -> DataFrame:
    """(tab, side, month, state, n): the broken references per referring table, end and month of the relation.

    A relation without indexed_at is reported under the month ''. References are counted by name, end and month before
    they meet the names' states; only where an entity appears within a month are that month's references looked at one by one.
    """
    refs, names = _refs_and_names(relations, entities, stubs)
    refs = refs.withColumn("month", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")))
    periods = refs.groupBy("name", "side", "month").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    met = periods.join(names.select("name", "refs", "is_entity", "is_stub", "deleted", "first_seen"), "name")
    state = _state(F.when(F.col("first_seen") > F.col("hi"), True).when(F.col("first_seen") > F.col("lo"), None).otherwise(False))
    sure = met.select("side", "month", state.alias("state"), "n").where("state IS NOT NULL")
    torn = F.col("first_seen").isNotNull() & ~F.col("deleted") & (F.col("is_entity") + F.col("is_stub") > 0) & (F.col("first_seen") > F.col("lo")) & (F.col("first_seen") <= F.col("hi"))
    split = met.where(torn).select("name", "side", "refs", "first_seen", "month")
    # an entity has one first_seen, so a name is torn in one month at most
    first = split.groupBy("name").agg(F.max("refs").alias("refs"), F.max("first_seen").alias("first_seen"), F.max("month").alias("torn_month"), F.collect_set("side").alias("torn_sides"))
    late = spread_join(refs, first.select("name", "first_seen", "torn_month", "torn_sides"), "name", first, "refs").where("month = torn_month AND array_contains(torn_sides, side) AND at < first_seen")
    found = sure.unionByName(late.select("side", "month", F.lit("late").alias("state"), F.lit(1).cast("bigint").alias("n")))
    return found.groupBy(F.lit(tab).alias("tab"), "side", "month", "state").agg(F.sum("n").alias("n"))
