"""Breadth-first traversal by rounds of joins, from many seeds at once, and the queries built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators.graph import edges_of, named
from quarrygraph.operators.joins import spread_join
from quarrygraph.session import Scratch

#: A frontier of at most so many rows (two names each) is broadcast.
FRONTIER = 200_000
SALTS = 16


def trusted_edges(relations: DataFrame, kind: str = "all", include_unresolved: bool = False) -> DataFrame:
    """(src, tgt, kind) of relations of a kind; only resolved ones (or without a qualifier) unless told otherwise."""
    kept = relations if include_unresolved else relations.where(X.is_trusted(F.col("resolution_qualifier")))
    edges = edges_of(kept)
    return edges if kind == "all" else edges.where(F.col("kind") == kind)


def reached(edges: DataFrame, nodes: DataFrame, rows: int, by: str) -> DataFrame:
    """``edges`` with the columns of ``nodes`` (keyed by ``by``) whose ``by`` is among them, by way of the smaller side.

    ``rows`` is the true number of ``nodes``. Up to FRONTIER of them are broadcast, so the edges stay where they are and
    a node that owns most edges costs nothing more; beyond that the edges are shuffled, hot nodes' ones dealt over tasks.
    """
    if rows <= FRONTIER:
        return edges.join(F.broadcast(nodes), by)
    keys = nodes.select(by).distinct()
    counts = edges.groupBy(by).agg(F.count(F.lit(1)).alias("_edges"))
    met = spread_join(edges, keys, by, counts, "_edges")
    salted = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return met.withColumn("_salt", F.pmod(F.xxhash64(*edges.columns), F.lit(SALTS)).cast("int")).join(salted, [by, "_salt"]).drop("_salt")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(seed, node, relation, depth): each node other than the seed reached within ``depth`` hops, once, at its least depth.

    ``seeds`` has one column, seed. Of several discovering edges the least kind names the relation. The edges are
    written once; each hop joins the frontier's nodes to them and drops what was visited; a round that finds nothing
    ends it. Cycles and loops are no problem; no seeds or depth 0 give no rows.
    """
    work = Scratch(edges.sparkSession)
    a, b = ("src", "tgt") if direction == "out" else ("tgt", "src")
    kept = edges if hasattr(edges, "_scratch_path") else work.cut(edges)
    step = kept.select(F.col(a).alias("node"), F.col(b).alias("next"), "kind")
    n = F.count(F.lit(1))
    first = seeds.select("seed", F.col("seed").alias("node")).where("seed IS NOT NULL").distinct()
    visited, told = work.told(first.select("seed", "node", F.lit(None).cast("string").alias("relation"), F.lit(0).alias("depth")), n=n)
    frontier = visited.select("seed", "node")
    for d in range(1, depth + 1):
        if not told["n"]:
            break
        met = reached(step, frontier, told["n"], "node").groupBy("seed", F.col("next").alias("node")).agg(F.min("kind").alias("relation"))
        new, told = work.told(met.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "relation", F.lit(d).alias("depth")), n=n)
        visited = visited.unionByName(new)
        frontier = new.select("seed", "node")
    return visited.where("depth > 0")


def resolve_name(entities: DataFrame, name: str) -> str:
    """The name itself if it is an entity, else the only one that ends with '.name', else with '::name', else unchanged."""
    if not named(entities).where(F.col("entity_name") == name).isEmpty():
        return name
    for sep in (".", "::"):
        found = named(entities).where(F.col("entity_name").endswith(sep + name)).select("entity_name").distinct().limit(2).collect()
        if len(found) == 1:
            return found[0][0]
    return name


def graph_query(relations: DataFrame, entities: DataFrame, name: str, direction: str = "both", kind: str = "all", depth: int = 1, include_unresolved: bool = False) -> DataFrame:
    """(side, entity, relation, source_id): callers and callees of a name; a class also has the callees of its methods."""
    spark = relations.sparkSession
    start = resolve_name(entities, name)
    edges = Scratch(spark).cut(trusted_edges(relations, kind, include_unresolved))
    seed = spark.createDataFrame([(start,)], "seed string")
    sides = []
    if direction in ("callees", "both"):
        out = bfs(edges, seed, depth, "out").select("node", "relation", F.lit(0).alias("own"))
        if not entities.where((F.col("entity_name") == start) & (F.col("entity_type") == "class")).isEmpty():
            methods = named(entities).where(F.col("entity_name").startswith(start + ".") | F.col("entity_name").startswith(start + "::")).select(F.col("entity_name").alias("seed"))
            out = out.unionByName(bfs(edges, methods, depth, "out").select("node", "relation", F.lit(1).alias("own")))
        best = out.groupBy("node").agg(F.min(F.struct("own", "relation")).alias("b")).select("node", F.col("b.relation").alias("relation"))
        sides.append(best.select(F.lit("callees").alias("side"), "node", "relation"))
    if direction in ("callers", "both"):
        sides.append(bfs(edges, seed, depth, "in").select(F.lit("callers").alias("side"), "node", "relation"))
    found = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    info = named(entities).select(F.col("entity_name").alias("node"), "source_id")
    return found.join(info, "node", "left").select("side", F.col("node").alias("entity"), "relation", X.text(F.col("source_id")).alias("source_id"))


def attach_relations(matches: DataFrame, relations: DataFrame, depth: int = 1) -> DataFrame:
    """(entity, side, other, relation) of the trusted callers and callees of every match (entity)."""
    seeds, edges = matches.select(F.col("entity").alias("seed")), Scratch(relations.sparkSession).cut(trusted_edges(relations))
    side = lambda d, name: bfs(edges, seeds, depth, d).select(F.col("seed").alias("entity"), F.lit(name).alias("side"), F.col("node").alias("other"), "relation")
    return side("in", "callers").unionByName(side("out", "callees"))
