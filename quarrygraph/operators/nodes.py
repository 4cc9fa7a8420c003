"""Per-node figures of the relations although a few nodes own a large share of the edges (problem 1).

Each edge becomes two small rows, one for each end. Spark's algebraic aggregates combine them per partition, counts and
sums in a bounded hash table that spills when full, the latest delivery of an ord (a maximum over text) by sorting; what is
shuffled is one partial state per partition, node and kind, never the edges of a node. A node with a third of all edges thus costs its reducer one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators.counted import counted


def _end(side: str, node: str) -> Column:
    return F.struct(F.lit(side).alias("side"), F.col(node).alias("node"))


def edge_ends(relations: DataFrame) -> DataFrame:
    """(side, node, kind, weight, other): both ends of each counted relation. Null ends give no row."""
    edges = counted(relations, ["ord"], "indexed_at", ["src_id", "tgt_id", "keywords", "weight"])
    kind = F.lower(F.trim(F.coalesce("keywords", F.lit(""))))
    return (
        edges.select(F.explode(F.array(_end("src", "src_id"), _end("tgt", "tgt_id"))).alias("e"), kind.alias("kind"), "weight")
        .select("e.side", "e.node", "kind", "weight")
        .where(F.col("node").isNotNull())
    )


def node_kinds(relations: DataFrame) -> DataFrame:
    """(side, node, kind, edges, weighted, weight_sum, weight_min, weight_max) for all nodes, one row per kind."""
    return (
        edge_ends(relations)
        .groupBy("side", "node", "kind")
        .agg(
            F.count(F.lit(1)).alias("edges"),
            F.count("weight").alias("weighted"),
            F.sum("weight").alias("weight_sum"),
            F.min("weight").alias("weight_min"),
            F.max("weight").alias("weight_max"),
        )
    )


def node_profile(relations: DataFrame) -> DataFrame:
    """(side, node, edges, kinds, weighted, weight_sum, weight_min, weight_max): in and out figures of every node.

    Needs ord, src_id, tgt_id, keywords, weight, indexed_at; other columns are ignored. Each ord counts once (its row
    with the latest indexed_at). Null weights count in ``edges`` only. The empty name is a node like any other.
    """
    return (
        node_kinds(relations)
        .groupBy("side", "node")
        .agg(
            F.sum("edges").alias("edges"),
            F.count(F.lit(1)).alias("kinds"),
            F.sum("weighted").alias("weighted"),
            F.sum("weight_sum").alias("weight_sum"),
            F.min("weight_min").alias("weight_min"),
            F.max("weight_max").alias("weight_max"),
        )
    )


def heavy_nodes(relations: DataFrame, percent: int = 2) -> DataFrame:
    """(side, node): nodes that are the source (target) of at least ``percent`` % of all ords. Empty input, empty result."""
    edges = counted(relations, ["ord"], "indexed_at", ["src_id", "tgt_id"])
    ends = edges.select(F.explode(F.array(_end("src", "src_id"), _end("tgt", "tgt_id"))).alias("e")).select("e.*").where(F.col("node").isNotNull())
    counts = ends.groupBy("side", "node").agg(F.count(F.lit(1)).alias("edges"))
    total = counts.groupBy("side").agg(F.sum("edges").alias("total"))
    return counts.join(F.broadcast(total), "side").where(F.col("edges") * 100 >= F.col("total") * percent).select("side", "node")
