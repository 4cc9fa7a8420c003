"""Another tool's code graph: its nodes, edges and metadata as tables (Parquet extracts or JDBC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X

# That tool's schema and kinds.
TABLES = ["nodes", "edges", "files", "unresolved_refs", "project_metadata"]
NODE_COLUMNS = ["id", "kind", "qualified_name", "file_path", "start_line", "end_line", "docstring", "signature"]
EDGE_COLUMNS = ["source", "target", "kind", "line", "provenance"]
NODE_KINDS = "class struct interface trait protocol function method property field variable constant enum type_alias route component file".split()
EDGE_KINDS = {"calls": "CALLS", "imports": "IMPORTS", "extends": "INHERITS", "implements": "INHERITS", "instantiates": "CALLS", "references": "REFERENCES", "decorates": "REFERENCES"}
MOST_VERSION = 24


def read_jdbc(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    """The tables of a database that JDBC can reach."""
    return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in TABLES}


def check(tables: dict[str, DataFrame]) -> None:
    """Raises ValueError if a table or column is missing or the extraction version is newer than known. More columns are fine."""
    if lost := sorted(set(TABLES) - set(tables)):
        raise ValueError(f"missing tables: {lost}")
    for t, cols in (("nodes", NODE_COLUMNS), ("edges", EDGE_COLUMNS)):
        if lost := sorted(set(cols) - set(tables[t].columns)):
            raise ValueError(f"missing columns of {t}: {lost}")
    row = tables["project_metadata"].where("key = 'extraction_version'").select(F.col("value").cast("int")).first()
    if row and row[0] is not None and row[0] > MOST_VERSION:
        raise ValueError(f"extraction version {row[0]} is newer than {MOST_VERSION}")


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (fingerprint): 'nodes/edges/latest update'."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("updated_at"), F.lit(0)).cast("bigint").alias("u")).withColumn("one", F.lit(1))
    e = edges.agg(F.count(F.lit(1)).alias("e")).withColumn("one", F.lit(1))
    return n.join(F.broadcast(e), "one").select(F.format_string("%d/%d/%d", "n", "e", "u").alias("fingerprint"))


def _names(nodes: DataFrame) -> DataFrame:
    """Known nodes with ``entity_name``: the qualified name, behind the file's path if several nodes have it.

    How often a name occurs is counted by aggregation and joined, so a name that very many nodes share is no bottleneck.
    """
    known = nodes.where(F.col("kind").isin(NODE_KINDS))
    twice = known.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("qualified_name", F.lit(True).alias("_many"))
    name = F.when(F.col("_many"), F.concat_ws("::", "file_path", "qualified_name")).otherwise(F.col("qualified_name"))
    return known.join(twice, "qualified_name", "left").withColumn("entity_name", name)


def entities(nodes: DataFrame) -> DataFrame:
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return _names(nodes).select(
        "entity_name", F.col("kind").alias("entity_type"), F.concat_ws(" | ", some("signature"), some("docstring")).alias("description"), F.concat_ws(":", "file_path", F.coalesce(F.col("start_line").cast("string"), F.lit("None"))).alias("source_id"), X.text(F.col("signature")).alias("signature"), "file_path", F.lit("codegraph").alias("provenance")
    )


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of known kinds from a known node; to a known node they are resolved, else unresolved at its raw name.

    ``source_id`` is '<source name>:<line>' as the tool writes it; ``src_file`` is the path.
    """
    kinds = F.create_map(*[F.lit(x) for kv in EDGE_KINDS.items() for x in kv])
    e = edges.select("source", "target", kinds[F.col("kind")].alias("keywords"), F.coalesce(F.col("line").cast("string"), F.lit("0")).alias("line"), "provenance").where("keywords IS NOT NULL")
    src = _names(nodes).select(F.col("id").alias("source"), F.col("entity_name").alias("src_id"), F.col("file_path").alias("src_file"))
    tgt = _names(nodes).select(F.col("id").alias("target"), F.col("entity_name").alias("known"))
    raw = nodes.select(F.col("id").alias("target"), F.col("qualified_name").alias("raw"))
    j = e.join(src, "source").join(tgt, "target", "left").join(raw, "target", "left")
    ok = F.col("known").isNotNull()
    name = F.when(ok, F.col("known")).otherwise(F.coalesce("raw", F.lit("<unresolved>")))
    at = F.concat_ws(":", "src_id", "line")
    return j.select(
        "src_id", name.alias("tgt_id"), "keywords", F.concat(F.col("keywords"), F.lit(" from "), F.col("src_id"), F.lit(" at "), at).alias("description"), at.alias("source_id"), F.when(ok, 1.0).otherwise(0.5).alias("weight"),
        F.when(ok, "resolved").otherwise("unresolved").alias("resolution_qualifier"), F.when(~ok, name).alias("dst_raw"), "provenance", "src_file",
    )
