"""The general problems 1 to 5 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.operators import changes, copies, hierarchy, nodes, references
from quarrygraph.plans.registry import query
from quarrygraph.session import table

REL = """rel AS (SELECT * FROM relations WHERE ord IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord ORDER BY indexed_at DESC NULLS LAST,
 src_id DESC NULLS LAST, tgt_id DESC NULLS LAST, keywords DESC NULLS LAST, weight DESC NULLS LAST, resolution_qualifier DESC NULLS LAST, source_id DESC NULLS LAST) = 1)"""
ENDS = f"""{REL}, ends AS (SELECT 'src' AS side, src_id AS node, lower(trim(keywords)) AS kind, weight FROM rel
 UNION ALL SELECT 'tgt', tgt_id, lower(trim(keywords)), weight FROM rel)"""


@query("p1_found", f"WITH {ENDS} SELECT side, node FROM ends GROUP BY ALL HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM rel)")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nodes.heavy_nodes(table(spark, d, "relations"))


@query(
    "p1_nodes",
    f"WITH {ENDS} SELECT side, node, count(*) AS edges, count(DISTINCT kind) AS kinds, count(weight) AS weighted, round(sum(weight), 6) AS weight_sum, min(weight) AS weight_min, max(weight) AS weight_max FROM ends GROUP BY side, node",
)
def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes.node_profile(table(spark, d, "relations")).withColumn("weight_sum", F.round("weight_sum", 6))


BROKEN = f"""{REL}, refs AS (SELECT ord, 'src' AS side, src_id AS name, indexed_at AS made FROM rel WHERE src_id NOT IN ('', '<unresolved>')
 UNION ALL SELECT ord, 'tgt', tgt_id, indexed_at FROM rel WHERE tgt_id NOT IN ('', '<unresolved>') AND coalesce(resolution_qualifier, 'resolved') = 'resolved'),
 ent AS (SELECT entity_name AS name, min(indexed_at) AS first_seen, max(indexed_at) AS last_seen, max(indexed_at) FILTER (WHERE deleted_at IS NOT NULL) AS last_deleted FROM entities GROUP BY 1),
 stub AS (SELECT DISTINCT entity_name AS name FROM stub_entities),
 broken AS (SELECT ord, side, made, CASE WHEN e.name IS NULL AND s.name IS NULL THEN 'missing' WHEN last_deleted = last_seen THEN 'deleted' WHEN first_seen > made THEN 'late' END AS state
  FROM refs LEFT JOIN ent e ON refs.name = e.name LEFT JOIN stub s ON refs.name = s.name)"""


def _broken(f, spark: SparkSession, d: str) -> DataFrame:
    return f(*[table(spark, d, t) for t in ("relations", "entities", "stub_entities")])


@query("p2_found", f"WITH {BROKEN} SELECT ord, side, state FROM broken WHERE state IS NOT NULL")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(references.broken_references, spark, d).select("ord", "side", "state")


@query("p2_report", f"WITH {BROKEN} SELECT 'relations' AS tab, side, strftime(made, '%Y-%m') AS month, state, count(*) AS n FROM broken WHERE state IS NOT NULL GROUP BY ALL")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _broken(references.broken_report, spark, d)


LINKS = f"""{REL}, links AS (SELECT src_id AS node, min(tgt_id) AS parent FROM rel WHERE lower(trim(keywords)) IN ('inherits', 'extends')
 AND coalesce(resolution_qualifier, 'resolved') = 'resolved' AND tgt_id NOT IN ('', '<unresolved>') GROUP BY 1),
 reach AS (SELECT node, parent AS above FROM links UNION SELECT r.node, l.parent FROM reach r JOIN links l ON r.above = l.node),
 ring AS (SELECT node FROM reach WHERE node = above),
 looped AS (SELECT r.node, min(above) AS low FROM reach r JOIN ring ON r.above = ring.node GROUP BY 1),
 deep AS (SELECT node, count(*) AS depth FROM reach GROUP BY 1)"""
TREE = f"""{LINKS}, up AS (SELECT r.node, r.above, coalesce(d.depth, 0) AS above_depth FROM reach r LEFT JOIN deep d ON d.node = r.above WHERE r.node NOT IN (SELECT node FROM looped))"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.inheritance_links(table(spark, d, "relations")))


@query(
    "p3_found",
    f"""WITH RECURSIVE {LINKS} SELECT l.node, coalesce(low, top.above) AS root, CAST(CASE WHEN ring.node IS NOT NULL THEN -1 WHEN low IS NOT NULL THEN -2 ELSE depth END AS INTEGER) AS depth
 FROM links l JOIN deep USING (node) LEFT JOIN looped USING (node) LEFT JOIN ring USING (node)
 LEFT JOIN (SELECT node, above FROM reach WHERE above NOT IN (SELECT node FROM links)) top USING (node)""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.inheritance_links(table(spark, d, "relations"))
    return hierarchy.depths(links).where("parent IS NOT NULL").select("node", "root", F.col("depth").cast("int").alias("depth"))


@query("p3_paths", f"WITH RECURSIVE {TREE} SELECT node, string_agg(above, ' > ' ORDER BY above_depth) || ' > ' || node AS path FROM up GROUP BY node")
def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_tree(spark, d))


@query("p3_descendants", f"WITH RECURSIVE {TREE} SELECT above AS ancestor, up.node, d.depth - above_depth AS distance FROM up JOIN deep d USING (node)")
def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_tree(spark, d))


CHANGES = """snaps AS (SELECT snap_no, row_number() OVER (ORDER BY snap_no) AS rank FROM (SELECT DISTINCT snap_no FROM relation_snapshots)),
 rows AS (SELECT rank, s.* FROM relation_snapshots s JOIN snaps USING (snap_no) QUALIFY row_number() OVER (PARTITION BY snap_no, src_id, tgt_id, keywords ORDER BY delivered_at DESC) = 1),
 pairs AS (SELECT coalesce(b.rank, a.rank + 1) AS rank, coalesce(a.src_id, b.src_id) AS key1, coalesce(a.tgt_id, b.tgt_id) AS key2, coalesce(a.keywords, b.keywords) AS key3,
  CASE WHEN a.rank IS NULL THEN 'added' WHEN b.rank IS NULL THEN 'removed' WHEN coalesce(a.source_id, '') <> coalesce(b.source_id, '') OR coalesce(a.resolution_qualifier, '') <> coalesce(b.resolution_qualifier, '')
   OR (a.weight IS NULL) <> (b.weight IS NULL) OR abs(a.weight - b.weight) >= 1e-9 THEN 'changed' END AS change
  FROM rows a FULL JOIN rows b ON a.src_id = b.src_id AND a.tgt_id = b.tgt_id AND a.keywords = b.keywords AND a.rank + 1 = b.rank)
 SELECT CAST(snap_no AS INTEGER) AS snap_no, 'relations' AS tab, key1, key2, key3, change FROM pairs JOIN snaps USING (rank) WHERE change IS NOT NULL AND rank > 1"""


def _value(x: str, depth: int = 2) -> str:
    """A JSON value as text in SQL: null where it counts as absent, numbers by value, the order of properties settled; lists and objects down to ``depth``."""
    e, q = f"e{depth}", f"q{depth}"
    scalars = f"CASE json_type({x}) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 's' || nullif(json_extract_string({x}, '$'), '') WHEN 'BOOLEAN' THEN CAST({x} AS VARCHAR)"
    rest = f"ELSE 'n' || CAST(TRY_CAST({x} AS DOUBLE) AS VARCHAR) END"
    if depth == 0:
        return f"{scalars} WHEN 'ARRAY' THEN CAST({x} AS VARCHAR) WHEN 'OBJECT' THEN CAST({x} AS VARCHAR) {rest}"
    items = f"array_to_string(list_transform(TRY_CAST({x} AS JSON[]), lambda {e}: coalesce({_value(e, depth - 1)}, 'null')), ',')"
    child = f"""json_extract({x}, '$."' || {q} || '"')"""
    fields = f"array_to_string(list_sort(list_filter(list_transform(json_keys({x}), lambda {q}: {q} || '=' || {_value(child, depth - 1)}), lambda x: x IS NOT NULL)), chr(3))"
    return f"{scalars} WHEN 'ARRAY' THEN '[' || {items} || ']' WHEN 'OBJECT' THEN '{{' || {fields} || '}}' {rest}"


def _property(p: str, k: str) -> str:
    return _value(f"""json_extract({p}, '$."' || {k} || '"')""", 1)


def _is_object(p: str) -> str:
    return f"(CASE WHEN json_valid({p}) THEN json_type({p}) = 'OBJECT' ELSE false END)"


def _content(p: str) -> str:
    return f"CASE WHEN coalesce(trim({p}), '') IN ('', 'null') THEN '' WHEN NOT {_is_object(p)} THEN 'invalid' || {p} ELSE array_to_string(list_sort(list_filter(list_transform(json_keys({p}), lambda k: k || '=' || {_property(p, 'k')}), lambda x: x IS NOT NULL)), chr(1)) END"


ENTITY_CHANGES = f"""esnaps AS (SELECT snap_no, row_number() OVER (ORDER BY snap_no) AS rank FROM (SELECT DISTINCT snap_no FROM entity_snapshots)),
 erows AS (SELECT rank, entity_name, concat_ws(chr(2), coalesce(entity_type, ''), coalesce(description, ''), coalesce(source_id, ''), {_content('properties_json')}) AS v FROM entity_snapshots s JOIN esnaps USING (snap_no) QUALIFY row_number() OVER (PARTITION BY snap_no, entity_name ORDER BY delivered_at DESC) = 1),
 epairs AS (SELECT coalesce(b.rank, a.rank + 1) AS rank, coalesce(a.entity_name, b.entity_name) AS key1, CASE WHEN a.rank IS NULL THEN 'added' WHEN b.rank IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change FROM erows a FULL JOIN erows b ON a.entity_name = b.entity_name AND a.rank + 1 = b.rank)"""


@query("p4_found", f"WITH {ENTITY_CHANGES} SELECT CAST(snap_no AS INTEGER) AS snap_no, 'entities' AS tab, key1, '' AS key2, '' AS key3, change FROM epairs JOIN esnaps USING (rank) WHERE change IS NOT NULL AND rank > 1 UNION ALL FROM (WITH {CHANGES})")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.entity_changes(table(spark, d, "entity_snapshots")).unionByName(changes.relation_changes(table(spark, d, "relation_snapshots")))


@query("p4_relations", f"WITH {CHANGES}")
def p4_relations(spark: SparkSession, d: str) -> DataFrame:
    return changes.relation_changes(table(spark, d, "relation_snapshots"))


_FIELDS = ["src_id", "tgt_id", "keywords", "source_id", "resolution_qualifier"]
_LAST = "QUALIFY row_number() OVER (PARTITION BY ord ORDER BY indexed_at DESC NULLS LAST, src_id DESC, tgt_id DESC, keywords DESC, source_id DESC NULLS LAST, weight DESC NULLS LAST, resolution_qualifier DESC NULLS LAST) = 1"


RELATION_DIFFERENCES = (
    f"WITH a AS MATERIALIZED (SELECT * FROM relations WHERE ord IS NOT NULL {_LAST}), b AS MATERIALIZED (SELECT * FROM relations_mirror WHERE ord IS NOT NULL {_LAST}) "
    "SELECT 'relations' AS tab, CAST(ord AS VARCHAR) AS rec_key, '' AS field, 'only_main' AS diff FROM a ANTI JOIN b USING (ord) "
    "UNION ALL SELECT 'relations', CAST(ord AS VARCHAR), '', 'only_mirror' FROM b ANTI JOIN a USING (ord) "
    + "".join(f"UNION ALL SELECT 'relations', CAST(ord AS VARCHAR), '{f}', 'differs' FROM a JOIN b USING (ord) WHERE coalesce(a.{f}, '') <> coalesce(b.{f}, '') " for f in _FIELDS)
    + "UNION ALL SELECT 'relations', CAST(ord AS VARCHAR), 'weight', 'differs' FROM a JOIN b USING (ord) WHERE (a.weight IS NULL) <> (b.weight IS NULL) OR abs(a.weight - b.weight) >= 1e-9"
)


@query("p5_relations", RELATION_DIFFERENCES)
def p5_relations(spark: SparkSession, d: str) -> DataFrame:
    return copies.relation_differences(table(spark, d, "relations"), table(spark, d, "relations_mirror"))


_LATEST = "QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY indexed_at DESC NULLS LAST, entity_type DESC NULLS LAST, description DESC NULLS LAST, source_id DESC NULLS LAST, properties_json DESC NULLS LAST) = 1"
ENTITY_DIFFERENCES = (
    f"WITH a AS MATERIALIZED (SELECT * FROM entities WHERE entity_name IS NOT NULL {_LATEST}), b AS MATERIALIZED (SELECT * FROM entities_mirror WHERE entity_name IS NOT NULL {_LATEST}), "
    "j AS MATERIALIZED (SELECT entity_name, coalesce(nullif(trim(a.properties_json), ''), '{}') AS pa, coalesce(nullif(trim(b.properties_json), ''), '{}') AS pb FROM a JOIN b USING (entity_name) WHERE a.properties_json IS DISTINCT FROM b.properties_json), "
    f"ok AS MATERIALIZED (SELECT * FROM j WHERE {_is_object('pa')} AND {_is_object('pb')}), k AS (SELECT DISTINCT entity_name, pa, pb, unnest(list_concat(json_keys(pa), json_keys(pb))) AS k FROM ok) "
    "SELECT 'entities' AS tab, entity_name AS rec_key, '' AS field, 'only_main' AS diff FROM a ANTI JOIN b USING (entity_name) UNION ALL SELECT 'entities', entity_name, '', 'only_mirror' FROM b ANTI JOIN a USING (entity_name) "
    + "".join(f"UNION ALL SELECT 'entities', entity_name, '{f}', 'differs' FROM a JOIN b USING (entity_name) WHERE coalesce(a.{f}, '') <> coalesce(b.{f}, '') " for f in ("entity_type", "description", "source_id"))
    + "UNION ALL SELECT 'entities', entity_name, 'properties_json', 'differs' FROM j ANTI JOIN ok USING (entity_name) "
    + f"UNION ALL SELECT 'entities', entity_name, 'properties_json.' || k, 'differs' FROM k WHERE ({_property('pa', 'k')}) IS DISTINCT FROM ({_property('pb', 'k')})"
)


@query("p5_found", f"FROM ({ENTITY_DIFFERENCES}) UNION ALL FROM ({RELATION_DIFFERENCES})")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ent = copies.entity_differences(table(spark, d, "entities"), table(spark, d, "entities_mirror"))
    return ent.unionByName(copies.relation_differences(table(spark, d, "relations"), table(spark, d, "relations_mirror")))
