"""The driver's tables as graphs: the live code graph, its first and last snapshot, commits; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators.counted import counted
from quarrygraph.plans.problems import REL
from quarrygraph.session import table

ENTITY = ["entity_type", "description", "source_id", "properties_json"]
EDGE = ["src_id", "tgt_id", "keywords"]
NOW = 1_900_000_000


def entities(spark: SparkSession, d: str) -> DataFrame:
    """The counted rows that are not deleted."""
    return counted(table(spark, d, "entities"), ["entity_name"], "indexed_at", [*ENTITY, "deleted_at"]).where("deleted_at IS NULL AND entity_name <> ''").drop("deleted_at")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """The counted rows, one per (src_id, tgt_id, keywords): the latest, of equally late ones that with the greatest ord."""
    rest = ["weight", "resolution_qualifier", "source_id"]
    r = counted(table(spark, d, "relations"), ["ord"], "indexed_at", [*EDGE, *rest])
    return r.groupBy(*EDGE).agg(F.max(F.struct("indexed_at", "ord", *rest)).alias("r")).select(*EDGE, "r.ord", "r.indexed_at", *[f"r.{c}" for c in rest])


def snapshot(spark: SparkSession, d: str, which: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of the 'min' or 'max' snapshot."""
    out = []
    for name, keys, cols in (("entity_snapshots", ["entity_name"], ENTITY), ("relation_snapshots", EDGE, ["weight", "resolution_qualifier", "source_id"])):
        t = table(spark, d, name)
        no = t.agg(F.expr(f"{which}(snap_no)")).first()[0]
        out.append(counted(t.where(F.col("snap_no") == no), keys, "delivered_at", cols).drop("delivered_at"))
    return out[0], out[1]


def digest() -> object:
    return F.try_variant_get(F.try_parse_json("properties_json"), "$.content_hash", "string")


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits of their customers to files: one file per part, of every seventh part one per line number and quantity, so that files of one author occur."""
    file = F.when(F.col("l_partkey") % 7 == 0, F.format_string("src/p0/m%d_%d_%d.py", "l_partkey", F.col("l_linenumber").cast("bigint"), F.col("l_quantity").cast("bigint"))).otherwise(F.format_string("src/p%d/m%d.py", F.col("l_partkey") % 7, F.col("l_partkey")))
    li = table(spark, d, "lineitem").groupBy("l_orderkey", file.alias("path")).agg(F.sum("l_quantity").cast("bigint").alias("added"), F.sum("l_linenumber").cast("bigint").alias("deleted"))
    files = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("path", "added", "deleted")).alias("files"))
    o = table(spark, d, "orders")
    subject = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "fix: ").otherwise("feat: "), F.lower("o_orderpriority"))
    return o.join(files, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lower(F.hex("o_orderkey")).alias("sha"), F.concat(F.lit("c"), F.col("o_custkey")).alias("author"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), subject.alias("message"), "files")


# the same in SQL

_TIES = ", ".join(f"{c} DESC NULLS LAST" for c in ENTITY)
ENT = f"""e AS (SELECT * FROM (SELECT * FROM entities WHERE entity_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY indexed_at DESC NULLS LAST, {_TIES}, deleted_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL AND entity_name <> '')"""
GRAPH = f"""{REL}, {ENT}, r AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY src_id, tgt_id, keywords ORDER BY indexed_at DESC NULLS LAST, ord DESC) = 1),
 ed AS (SELECT src_id AS src, tgt_id AS tgt, keywords AS kind FROM r WHERE src_id <> '' AND tgt_id <> ''),
 re AS (SELECT * FROM ed WHERE src IN (SELECT entity_name FROM e) AND tgt IN (SELECT entity_name FROM e))"""


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_module(s: str, depth: int) -> str:
    parts = f"list_filter(string_split(coalesce({s}, ''), '/'), lambda x: x <> '' AND x <> '.')"
    return f"CASE WHEN len({parts}) <= 1 THEN '.' ELSE array_to_string({parts}[1:least({depth}, len({parts}) - 1)], '/') END"


ANALYSED = f"""a AS (SELECT * FROM e WHERE coalesce(entity_type, '') <> 'external' AND coalesce(source_id, '') <> 'external' AND entity_name NOT IN ({quoted(X.LIBRARY_NAMES)})
 AND NOT regexp_matches(entity_name, '\\.({"|".join(m[1:] for m in X.GENERIC_METHODS)})$')),
 ra AS (SELECT * FROM ed WHERE src IN (SELECT entity_name FROM a) AND tgt IN (SELECT entity_name FROM a)),
 m AS (SELECT entity_name, {sql_module("source_id", 2)} AS module FROM a),
 pairs AS (SELECT s.module AS from_module, t.module AS to_module, kind FROM ed JOIN m s ON s.entity_name = src JOIN m t ON t.entity_name = tgt)"""
_PARTS = "CASE WHEN contains(entity_name, '::') THEN string_split(entity_name, '::') ELSE string_split(entity_name, '.') END"
UNLINKED = f"""(entity_name IN ({quoted(X.UNLINKED_NAMES)}) OR contains(coalesce(source_id, ''), 'tests/') OR starts_with(coalesce(source_id, ''), 'test_') OR contains(coalesce(source_id, ''), 'models.py') OR contains(coalesce(source_id, ''), '/models/')
 OR (len({_PARTS}) > 1 AND (({_PARTS})[-1] IN ({quoted(X.UNLINKED_NAMES)}) OR (starts_with(({_PARTS})[-1], '__') AND ends_with(({_PARTS})[-1], '__')))) OR regexp_matches(({_PARTS})[1], '({"|".join(X.UNLINKED_ENDS)})$'))"""
FINDINGS = f"""o AS (SELECT entity_name AS entity, coalesce(entity_type, 'unknown') AS type, coalesce(source_id, '') AS source_id,
  CASE WHEN entity_name IN (SELECT src FROM ed UNION ALL SELECT tgt FROM ed) THEN 'neighbors_unresolved' ELSE 'truly_isolated' END AS reason FROM a
  WHERE coalesce(entity_type, '') NOT IN ('module', 'file') AND entity_name NOT IN (SELECT src FROM ra UNION ALL SELECT tgt FROM ra)
  AND NOT (coalesce(entity_type, '') = 'class' AND entity_name || '.__init__' IN (SELECT src FROM ra UNION ALL SELECT tgt FROM ra)) AND NOT {UNLINKED}),
 deg AS (SELECT entity_name AS entity, coalesce(entity_type, 'unknown') AS type, coalesce(source_id, '') AS source_id, i.n AS n_in, x.n AS n_out FROM a
  LEFT JOIN (SELECT tgt, count(*) AS n FROM ra GROUP BY 1) i ON i.tgt = entity_name LEFT JOIN (SELECT src, count(*) AS n FROM ra GROUP BY 1) x ON x.src = entity_name WHERE coalesce(entity_type, '') NOT IN ('module', 'file')),
 hub AS (SELECT entity, type, source_id, n_in AS degree FROM deg WHERE n_in >= 8 AND entity NOT IN ({quoted(X.SHARED_NAMES)}) AND NOT contains(source_id, '_common.py') AND NOT contains(source_id, '/config.py')),
 god AS (SELECT entity, type, source_id, n_out AS degree FROM deg WHERE n_out >= 10),
 cp AS (SELECT count(*) FILTER (WHERE from_module <> to_module) AS cross_module, count(*) FILTER (WHERE from_module = to_module) AS intra_module FROM pairs)"""
TOPOLOGY = f"{GRAPH}, {ANALYSED}, {FINDINGS}"


def _side(name: str, tab: str, which: str, keys: str) -> str:
    return f"{name} AS (SELECT * FROM {tab} WHERE snap_no = (SELECT {which}(snap_no) FROM {tab}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY delivered_at DESC) = 1)"


_EK, _RK = "entity_name", "src_id, tgt_id, keywords"
SIDES = ", ".join([_side("be", "entity_snapshots", "min", _EK), _side("br", "relation_snapshots", "min", _RK), _side("he", "entity_snapshots", "max", _EK), _side("hr", "relation_snapshots", "max", _RK)])
BRANCH = (
    SIDES
    + """, b AS (SELECT src_id AS src, tgt_id AS tgt, keywords AS kind FROM br WHERE src_id IN (SELECT entity_name FROM be) AND tgt_id IN (SELECT entity_name FROM be) AND src_id <> '' AND tgt_id <> ''),
 h AS (SELECT src_id AS src, tgt_id AS tgt, keywords AS kind FROM hr WHERE src_id IN (SELECT entity_name FROM he) AND tgt_id IN (SELECT entity_name FROM he) AND src_id <> '' AND tgt_id <> ''),
 ch AS (SELECT *, 'removed' AS change FROM (FROM b EXCEPT FROM h) UNION ALL SELECT *, 'added' FROM (FROM h EXCEPT FROM b))"""
)
COMMITS = """li AS (SELECT l_orderkey, CASE WHEN l_partkey % 7 = 0 THEN 'src/p0/m' || l_partkey || '_' || l_linenumber || '_' || CAST(l_quantity AS BIGINT) || '.py' ELSE 'src/p' || (l_partkey % 7) || '/m' || l_partkey || '.py' END AS file,
  CAST(sum(l_quantity) AS BIGINT) AS added, CAST(sum(l_linenumber) AS BIGINT) AS deleted FROM lineitem GROUP BY 1, 2),
 c AS (SELECT file, 'c' || o_custkey AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS fix, added, deleted, o_orderkey FROM li JOIN orders ON o_orderkey = l_orderkey),
 per AS (SELECT file, author, count(*) AS n FROM c GROUP BY 1, 2),
 fm AS (SELECT file, count(*) AS commits, count(DISTINCT author) AS authors, (SELECT author FROM per WHERE per.file = c.file ORDER BY n DESC, author LIMIT 1) AS primary_author, CAST(sum(fix) AS BIGINT) AS bug_fixes,
  CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_deleted, max(ts) AS modified, min(ts) AS created FROM c GROUP BY file),
 hs AS (SELECT *, CASE WHEN lines_added + lines_deleted > 0 THEN least(100, CAST(trunc(commits * log10(lines_added + lines_deleted + 1) * 10) AS INTEGER)) ELSE 0 END AS score FROM fm),
 hot AS (SELECT row_number() OVER (ORDER BY score DESC, file) AS rank, file, commits, greatest(100, (lines_added + lines_deleted) // 2) AS lines, score FROM hs WHERE score >= 20),
 silo AS (SELECT file, primary_author AS owner, authors AS contributors, CAST(CASE WHEN authors = 1 THEN 1.0 ELSE 0.75 END AS DOUBLE) AS ownership, commits, CASE WHEN (SELECT count(DISTINCT author) FROM c) = 1 THEN 'informational' WHEN authors = 1 THEN 'critical' ELSE 'high' END AS risk FROM fm WHERE authors <= 2)"""
