"""The engine's own operators over the whole of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.functions.names import matching_ratio
from quarrygraph.operators import debt, diffs, graph, history, impact, modules, search, store, traverse
from quarrygraph.plans import graphs as G
from quarrygraph.plans.registry import query
from quarrygraph.session import Scratch, table
from quarrygraph.sources import foreign, ndjson, textlogs
from quarrygraph.streaming.ingest import windowed_counts


def _er(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.entities(spark, d), G.relations(spark, d)


def _topology(spark: SparkSession, d: str) -> graph.Topology:
    e, r = _er(spark, d)
    return graph.Topology(r, e)


# degrees, orphans, topology

_DEG = "SELECT {0} AS entity, entity_type AS type, source_id, count(*) AS degree FROM re JOIN e ON entity_name = {0} GROUP BY ALL HAVING count(*) >= 5"


@query("graph_degree_in", f"WITH {G.GRAPH} {_DEG.format('tgt')}")
def graph_degree_in(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.degrees(r, e, "in")


@query("graph_degree_out", f"WITH {G.GRAPH} {_DEG.format('src')}")
def graph_degree_out(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.degrees(r, e, "out")


@query(
    "graph_orphans",
    f"""WITH {G.GRAPH} SELECT entity_name AS entity, entity_type AS type, source_id, EXISTS (SELECT 1 FROM ed WHERE src = entity_name) OR EXISTS (SELECT 1 FROM ed WHERE tgt = entity_name) AS has_relations
 FROM e WHERE entity_name NOT IN (SELECT src FROM re UNION ALL SELECT tgt FROM re) AND (entity_type IS NULL OR entity_type NOT IN ('module', 'file')) AND starts_with(coalesce(source_id, ''), 'src/')""",
)
def graph_orphans(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.orphans(r, e, X.CONTAINER_TYPES, "src/")


_STORE_MODULE = "array_to_string(string_split(coalesce(source_id, ''), '/')[1:2], '/')"


@query(
    "graph_stats",
    f"""WITH {G.GRAPH}, sm AS (SELECT entity_name, {_STORE_MODULE} AS module FROM e), p AS (SELECT s.module AS x, t.module AS y FROM ed JOIN sm s ON s.entity_name = src JOIN sm t ON t.entity_name = tgt WHERE s.module <> '' AND t.module <> ''),
 k AS (SELECT count(*) FILTER (WHERE x <> y) AS cross_module, count(*) FILTER (WHERE x = y) AS intra_module FROM p)
 SELECT (SELECT count(*) FROM e) AS entity_count, (SELECT count(*) FROM r) AS relation_count, cross_module, intra_module, round(coalesce(cross_module / nullif(cross_module + intra_module, 0), 0), 9) AS density FROM k""",
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.graph_stats(r, e).withColumn("density", F.round("density", 9))


@query(
    "graph_stats_prefix",
    f"""WITH {G.GRAPH}, s AS (SELECT entity_name, array_to_string(string_split(substr(source_id, 7), '/')[1:2], '/') AS module FROM e WHERE starts_with(coalesce(source_id, ''), 'tests/')),
 p AS (SELECT x.module AS x, y.module AS y FROM ed JOIN s x ON x.entity_name = src JOIN s y ON y.entity_name = tgt WHERE x.module <> '' AND y.module <> ''), k AS (SELECT count(*) FILTER (WHERE x <> y) AS cross_module, count(*) FILTER (WHERE x = y) AS intra_module FROM p)
 SELECT (SELECT count(*) FROM s) AS entity_count, (SELECT count(*) FROM r WHERE src_id IN (SELECT entity_name FROM s) OR tgt_id IN (SELECT entity_name FROM s)) AS relation_count, cross_module, intra_module, round(coalesce(cross_module / nullif(cross_module + intra_module, 0), 0), 9) AS density FROM k""",
)
def graph_stats_prefix(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.graph_stats(r, e, "tests/").withColumn("density", F.round("density", 9))


@query("coupled_pairs", f"WITH {G.GRAPH}, {G.ANALYSED} SELECT p.from_module, p.to_module, count(*) AS n FROM (SELECT s.module AS from_module, t.module AS to_module FROM ed JOIN (SELECT * FROM m WHERE module <> '.') s ON s.entity_name = src JOIN (SELECT * FROM m WHERE module <> '.') t ON t.entity_name = tgt) p WHERE from_module <> to_module GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")
def coupled_pairs(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.coupled_pairs(r, e)


@query("topology_orphans", f"WITH {G.TOPOLOGY} FROM o")
def topology_orphans(spark: SparkSession, d: str) -> DataFrame:
    return _topology(spark, d).orphans()


@query("topology_hubs", f"WITH {G.TOPOLOGY} FROM hub")
def topology_hubs(spark: SparkSession, d: str) -> DataFrame:
    return _topology(spark, d).hubs()


@query("topology_gods", f"WITH {G.TOPOLOGY} FROM god")
def topology_gods(spark: SparkSession, d: str) -> DataFrame:
    return _topology(spark, d).gods()


@query("topology_hub_samples", f"WITH {G.TOPOLOGY} SELECT entity, array_to_string(list(src ORDER BY src)[1:5], ', ') AS sample FROM hub JOIN ra ON tgt = entity GROUP BY entity")
def topology_hub_samples(spark: SparkSession, d: str) -> DataFrame:
    t = _topology(spark, d)
    return t.samples("tgt", t.hubs())


@query("topology_coupling", f"WITH {G.TOPOLOGY} SELECT cross_module, intra_module, round(coalesce(cross_module / nullif(cross_module + intra_module, 0), 0), 9) AS density FROM cp")
def topology_coupling(spark: SparkSession, d: str) -> DataFrame:
    return _topology(spark, d).coupling().withColumn("density", F.round("density", 9))


_RATIO = "(SELECT count(*) FROM r WHERE src_id IN (SELECT entity_name FROM {0}) AND tgt_id IN (SELECT entity_name FROM {0}))"


@query("resolution_ratio", f"WITH {G.GRAPH}, {G.ANALYSED} SELECT (SELECT count(*) FROM r) AS edges, {_RATIO.format('a')} AS resolvable, round({_RATIO.format('a')} / (SELECT count(*) FROM r), 4) AS ratio, {_RATIO.format('a')} / (SELECT count(*) FROM r) < 0.5 AS low")
def resolution_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _topology(spark, d).resolution().drop("caveat")


@query("placeholder_modules", f"WITH {G.GRAPH}, {G.ANALYSED} SELECT module, count(*) AS entities FROM m JOIN a USING (entity_name) WHERE source_id <> '' GROUP BY module HAVING bool_and(ends_with(entity_name, '__init__'))")
def placeholder_modules(spark: SparkSession, d: str) -> DataFrame:
    return _topology(spark, d).placeholders()


_SCORE = """sc AS (SELECT (SELECT count(*) FROM a) AS entities, (SELECT count(*) FROM o) AS orphans, (SELECT count(*) FROM hub) AS hubs, (SELECT count(*) FROM god) AS gods, 
 (SELECT count(*) FROM (SELECT module FROM m JOIN a USING (entity_name) WHERE source_id <> '' GROUP BY module HAVING bool_and(ends_with(entity_name, '__init__')))) AS placeholders, cross_module, intra_module,
 round(coalesce(cross_module / nullif(cross_module + intra_module, 0), 0), 9) AS density FROM cp),
 ts AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN orphans / entities > 0.2 THEN 25 WHEN orphans / entities > 0.1 THEN 15 ELSE 0 END - least(20, 5 * (SELECT count(*) FROM hub WHERE degree >= 15))
  - least(25, (SELECT coalesce(sum(CASE WHEN degree >= 25 THEN 5 WHEN degree >= 15 THEN 3 ELSE 0 END), 0) FROM god)) - least(15, 5 * placeholders) - CASE WHEN density > 0.5 THEN 10 WHEN density > 0.3 THEN 5 ELSE 0 END) AS INTEGER) AS score FROM sc)"""


@query("topology_score", f"WITH {G.TOPOLOGY}, {_SCORE} FROM ts")
def topology_score(spark: SparkSession, d: str) -> DataFrame:
    return _topology(spark, d).score().withColumn("density", F.round("density", 9))


@query("store_topology_hubs", f"WITH {G.GRAPH}, x AS ({_DEG.format('tgt').replace('>= 5', '>= 8')}) SELECT * FROM x WHERE coalesce(type, '') NOT IN ('module', 'file', 'external') AND coalesce(source_id, '') <> 'external' AND entity IN (SELECT entity_name FROM (WITH {G.GRAPH}, {G.ANALYSED} FROM a)) AND entity NOT IN ({G.quoted(X.SHARED_NAMES)})")
def store_topology_hubs(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.store_topology(r, e, prefix="")["hubs"]


# modules

_PLACED = f"pl AS (SELECT * FROM e WHERE coalesce(entity_type, '') <> 'external' AND source_id <> '' AND source_id <> 'external'), pm AS (SELECT entity_name, {G.sql_module('source_id', 2)} AS module, entity_type, source_id FROM pl)"
_DEPS = "SELECT s.module AS from_module, t.module AS to_module, kind, count(*) AS n FROM ed JOIN {0} s ON s.entity_name = src JOIN {0} t ON t.entity_name = tgt WHERE s.module <> t.module GROUP BY ALL"


@query("module_deps", f"WITH {G.GRAPH}, {_PLACED} {_DEPS.format('pm')}")
def module_deps(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return modules.dependencies(r, e)


@query("module_deps_depth1", f"WITH {G.GRAPH}, {_PLACED}, p1 AS (SELECT entity_name, {G.sql_module('source_id', 1)} AS module FROM pl) {_DEPS.format('p1')}")
def module_deps_depth1(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return modules.dependencies(r, e, 1, auto=False)


@query("module_overview_counts", f"WITH {G.ENT}, {_PLACED} SELECT module, coalesce(entity_type, 'unknown') AS type, count(*) AS n FROM pm GROUP BY ALL")
def module_overview_counts(spark: SparkSession, d: str) -> DataFrame:
    return modules.overview_counts(G.entities(spark, d))


@query("module_overview_files", f"WITH {G.ENT}, {_PLACED} SELECT DISTINCT module, string_split(string_split(source_id, ':')[1], '/')[-1] AS file FROM pm")
def module_overview_files(spark: SparkSession, d: str) -> DataFrame:
    return modules.overview_files(G.entities(spark, d))


@query("module_top_entities", f"WITH {G.GRAPH}, {_PLACED}, t AS (SELECT x AS entity_name, count(*) AS n FROM (SELECT src_id AS x FROM r UNION ALL SELECT tgt_id FROM r) GROUP BY 1) SELECT module, row_number() OVER (PARTITION BY module ORDER BY coalesce(n, 0) DESC, entity_name) AS rank, entity_name AS entity, coalesce(n, 0) AS n FROM pm LEFT JOIN t USING (entity_name) QUALIFY rank <= 10")
def module_top_entities(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return modules.overview_top(r, e)


@query("workspace_info", f"WITH {G.GRAPH} SELECT 'entities' AS tab, coalesce(entity_type, '') AS kind, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'relations', keywords, count(*) FROM r GROUP BY ALL")
def workspace_info(spark: SparkSession, d: str) -> DataFrame:
    return modules.type_counts(*_er(spark, d))


_LISTING = "SELECT DISTINCT regexp_replace(source_id, ':\\d+(-\\d+)?$', '') AS file FROM entities_mirror WHERE source_id <> ''"


@query("freshness", f"WITH {G.ENT}, f AS ({_LISTING}), p AS (SELECT DISTINCT regexp_replace(source_id, ':\\d+(-\\d+)?$', '') AS file FROM e WHERE source_id <> '' AND source_id <> 'external') SELECT file, file IN (SELECT file FROM f) AS fresh FROM p")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "entities_mirror").where("source_id <> ''").select(X.without_line_range(F.col("source_id")).alias("file"))
    return modules.freshness(G.entities(spark, d), files)


@query("freshness_summary", f"WITH {G.ENT}, f AS ({_LISTING}), p AS (SELECT DISTINCT regexp_replace(source_id, ':\\d+(-\\d+)?$', '') AS file FROM e WHERE source_id <> '' AND source_id <> 'external'), q AS (SELECT file IN (SELECT file FROM f) AS fresh FROM p) SELECT count(*) AS total, count(*) FILTER (WHERE fresh) AS valid, count(*) FILTER (WHERE NOT fresh) AS stale, round(count(*) FILTER (WHERE fresh) / count(*), 3) AS ratio FROM q")
def freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    return modules.freshness_summary(freshness(spark, d))


_LANG = "CASE lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in modules.LANGUAGES.items()) + " END"


@query("languages", f"WITH f AS ({_LISTING}) SELECT {_LANG} AS language, count(*) AS n FROM f WHERE {_LANG} IS NOT NULL AND NOT list_has_any(string_split(file, '/'), [{G.quoted(modules.VENDORED)}]) GROUP BY 1")
def languages(spark: SparkSession, d: str) -> DataFrame:
    return modules.languages(table(spark, d, "entities_mirror").where("source_id <> ''").select(X.without_line_range(F.col("source_id")).alias("file")).distinct())


# traversal

_TRUSTED = "tr AS (SELECT DISTINCT src_id AS src, tgt_id AS tgt, keywords AS kind FROM r WHERE src_id <> '' AND tgt_id <> '' AND coalesce(resolution_qualifier, 'resolved') = 'resolved')"


def _walk(a: str, b: str, seed: str, depth: int) -> str:
    return f"""WITH RECURSIVE {G.GRAPH}, {_TRUSTED}, w AS (SELECT seed, seed AS node, 0 AS depth FROM ({seed}) UNION SELECT w.seed, {b}, w.depth + 1 FROM w JOIN tr ON {a} = node WHERE w.depth < {depth}),
 best AS (SELECT seed, node, min(depth) AS depth FROM w GROUP BY 1, 2),
 lab AS (SELECT x.seed, x.node, x.depth, min(kind) AS relation FROM best x JOIN tr ON {b} = x.node JOIN best p ON p.seed = x.seed AND p.node = {a} AND p.depth = x.depth - 1 WHERE x.depth > 0 GROUP BY ALL)"""


@query("bfs_callees_3hop", _walk("src", "tgt", "SELECT 'weft.cli.dispatch_table' AS seed", 3) + " SELECT seed, node, relation, CAST(depth AS INTEGER) AS depth FROM lab")
def bfs_callees_3hop(spark: SparkSession, d: str) -> DataFrame:
    r = G.relations(spark, d)
    return traverse.bfs(traverse.trusted_edges(r), spark.createDataFrame([("weft.cli.dispatch_table",)], "seed string"), 3)


_ROOTS = "SELECT DISTINCT tgt_id AS seed FROM rel WHERE lower(trim(keywords)) = 'extends' AND tgt_id <> ''"


@query("bfs_callers_many", _walk("tgt", "src", _ROOTS, 2) + " SELECT seed, node, relation, CAST(depth AS INTEGER) AS depth FROM lab")
def bfs_callers_many(spark: SparkSession, d: str) -> DataFrame:
    r = G.relations(spark, d)
    seeds = r.where("lower(trim(keywords)) = 'extends' AND tgt_id <> ''").select(F.col("tgt_id").alias("seed")).distinct()
    return traverse.bfs(traverse.trusted_edges(r), seeds, 2, "in")


@query("graph_query", _walk("src", "tgt", "SELECT 'weft.boot.wire_all' AS seed", 1) + " SELECT 'callees' AS side, node AS entity, relation, coalesce(source_id, '') AS source_id FROM lab LEFT JOIN e ON entity_name = node UNION ALL SELECT 'callers', src, min(kind), any_value(coalesce(source_id, '')) FROM tr LEFT JOIN e ON entity_name = src WHERE tgt = 'weft.boot.wire_all' AND src <> tgt GROUP BY src")
def graph_query(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return traverse.graph_query(r, e, "weft.boot.wire_all")


@query("find_with_relations", _walk("src", "tgt", "SELECT entity_name AS seed FROM e WHERE contains(lower(entity_name), 'loader')", 1) + ", back AS (SELECT tgt AS seed, src AS node, min(kind) AS relation FROM tr WHERE contains(lower(tgt), 'loader') AND tgt IN (SELECT entity_name FROM e) AND src <> tgt GROUP BY 1, 2) SELECT seed AS entity, 'callees' AS side, node AS other, relation FROM lab UNION ALL SELECT seed, 'callers', node, relation FROM back")
def find_with_relations(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return traverse.attach_relations(search.find_exact(e, "Loader"), r)


# diffs of the first and the last snapshot


def _branch(spark: SparkSession, d: str) -> diffs.BranchDiff:
    return diffs.BranchDiff(*G.snapshot(spark, d, "min"), *G.snapshot(spark, d, "max"))


def _compare(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return diffs.compare(*G.snapshot(spark, d, "min"), *G.snapshot(spark, d, "max"))


@query("compare_entities", f"WITH {G.SIDES} SELECT coalesce(be.entity_name, he.entity_name) AS name, CASE WHEN he.entity_name IS NULL THEN 'only1' WHEN be.entity_name IS NULL THEN 'only2' ELSE 'both' END AS side, CASE WHEN he.entity_name IS NULL THEN be.entity_type ELSE he.entity_type END AS type, CASE WHEN he.entity_name IS NULL THEN be.source_id ELSE he.source_id END AS source_id FROM be FULL JOIN he ON be.entity_name = he.entity_name WHERE coalesce(be.entity_name, he.entity_name) <> ''")
def compare_entities(spark: SparkSession, d: str) -> DataFrame:
    return _compare(spark, d)["entities"]


_CR = f"{G.SIDES}, b0 AS (SELECT src_id AS src, tgt_id AS tgt, keywords AS kind FROM br WHERE src_id <> '' AND tgt_id <> ''), h0 AS (SELECT src_id AS src, tgt_id AS tgt, keywords AS kind FROM hr WHERE src_id <> '' AND tgt_id <> ''), c0 AS (SELECT *, 'removed' AS change FROM (FROM b0 EXCEPT FROM h0) UNION ALL SELECT *, 'added' FROM (FROM h0 EXCEPT FROM b0)), rc AS (SELECT DISTINCT n AS entity, change, src, tgt, kind FROM (SELECT src AS n, * FROM c0 UNION ALL SELECT tgt, * FROM c0) WHERE n IN (SELECT entity_name FROM be) AND n IN (SELECT entity_name FROM he))"


@query("compare_relations", f"WITH {_CR} FROM rc")
def compare_relations(spark: SparkSession, d: str) -> DataFrame:
    return _compare(spark, d)["relations"]


@query("compare_summary", f"WITH {_CR} SELECT (SELECT count(*) FROM be WHERE entity_name NOT IN (SELECT entity_name FROM he)) AS only_in_ws1, (SELECT count(*) FROM he WHERE entity_name NOT IN (SELECT entity_name FROM be)) AS only_in_ws2, (SELECT count(*) FROM he WHERE entity_name IN (SELECT entity_name FROM be)) AS in_both, (SELECT count(DISTINCT entity) FROM rc) AS relations_diff")
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return _compare(spark, d)["summary"]


@query("branch_diff_edges", f"WITH {G.BRANCH} FROM ch")
def branch_diff_edges(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d).edges()


@query("broken_chains", f"WITH {G.BRANCH} SELECT src, tgt, kind FROM ch WHERE change = 'removed' AND src IN (SELECT entity_name FROM he)")
def broken_chains(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d).broken_chains()


@query("new_chains", f"WITH {G.BRANCH} SELECT src, tgt, kind FROM ch WHERE change = 'added' AND src IN (SELECT entity_name FROM be)")
def new_chains(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d).new_chains()


_HASH = "CASE WHEN json_valid({0}.properties_json) THEN json_extract_string({0}.properties_json, '$.content_hash') END"
_CONTENT = f"ct AS (SELECT be.entity_name AS name, CASE WHEN {_HASH.format('be')} IS NULL OR {_HASH.format('he')} IS NULL THEN 'unknown' WHEN {_HASH.format('be')} = {_HASH.format('he')} THEN 'same' ELSE 'changed' END AS state FROM be JOIN he ON be.entity_name = he.entity_name WHERE be.entity_name <> '')"


@query("content_changes", f"WITH {G.SIDES}, {_CONTENT} FROM ct")
def content_changes(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d).content(G.digest())


@query("content_status", f"WITH {G.SIDES}, {_CONTENT}, n AS (SELECT count(*) FILTER (WHERE state <> 'unknown') AS comparable, count(*) FILTER (WHERE state = 'unknown') AS uncomparable, count(*) FILTER (WHERE state = 'changed') AS changed FROM ct) SELECT CASE WHEN comparable = 0 AND uncomparable > 0 THEN 'unavailable' WHEN uncomparable > 0 THEN 'partial' ELSE 'available' END AS status, * FROM n")
def content_status(spark: SparkSession, d: str) -> DataFrame:
    b = _branch(spark, d)
    return b.content_status(b.content(G.digest()))


_MD = f"md AS (SELECT module, count(*) FILTER (WHERE change = 'added') AS edges_added, count(*) FILTER (WHERE change = 'removed') AS edges_removed FROM (SELECT change, {G.sql_module('source_id', 2)} AS module FROM ch JOIN he ON entity_name = src WHERE change = 'added' UNION ALL SELECT change, {G.sql_module('source_id', 2)} FROM ch JOIN be ON entity_name = src WHERE change = 'removed') GROUP BY 1)"


@query("module_delta", f"WITH {G.BRANCH}, {_MD} FROM md")
def module_delta(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d).module_delta()


@query("module_delta_top", f"WITH {G.BRANCH}, {_MD} FROM md ORDER BY edges_added + edges_removed DESC, module LIMIT 20")
def module_delta_top(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d).top_modules()


@query(
    "branch_summary",
    f"""WITH {G.BRANCH}, {_MD} SELECT (SELECT count(*) FROM he WHERE entity_name NOT IN (SELECT entity_name FROM be)) AS entities_added, (SELECT count(*) FROM be WHERE entity_name NOT IN (SELECT entity_name FROM he)) AS entities_removed,
 (SELECT count(*) FROM be WHERE entity_name IN (SELECT entity_name FROM he)) AS entities_shared, (SELECT count(*) FILTER (WHERE change = 'added') FROM ch) AS edges_added, (SELECT count(*) FILTER (WHERE change = 'removed') FROM ch) AS edges_removed,
 (SELECT count(*) FROM ch WHERE change = 'removed' AND src IN (SELECT entity_name FROM he)) AS broken_chains, (SELECT count(*) FROM ch WHERE change = 'added' AND src IN (SELECT entity_name FROM be)) AS new_chains, (SELECT count(*) FROM md) AS modules_changed, (SELECT count(*) FROM br WHERE src_id <> '' AND tgt_id <> '' AND NOT (src_id IN (SELECT entity_name FROM be) AND tgt_id IN (SELECT entity_name FROM be))) AS base_unresolved_edges, (SELECT count(*) FROM hr WHERE src_id <> '' AND tgt_id <> '' AND NOT (src_id IN (SELECT entity_name FROM he) AND tgt_id IN (SELECT entity_name FROM he))) AS head_unresolved_edges""",
)
def branch_summary(spark: SparkSession, d: str) -> DataFrame:
    return _branch(spark, d).summary()


# mutations


@query("upsert_last_wins", "WITH n AS (SELECT * FROM relations_mirror WHERE ord IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src_id, tgt_id, keywords ORDER BY ord DESC, indexed_at DESC NULLS LAST, source_id DESC NULLS LAST, weight DESC NULLS LAST) = 1), o AS (SELECT src_id, tgt_id, keywords, max(ord) AS ord FROM relations GROUP BY ALL) SELECT src_id, tgt_id, keywords, ord FROM n UNION ALL SELECT src_id, tgt_id, keywords, ord FROM o WHERE (src_id, tgt_id, keywords) NOT IN (SELECT (src_id, tgt_id, keywords) FROM n)")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "relations").groupBy("src_id", "tgt_id", "keywords").agg(F.max("ord").alias("ord"))
    new = store.Workspace._last(table(spark, d, "relations_mirror").where("ord IS NOT NULL").select("src_id", "tgt_id", "keywords", "ord", "indexed_at", "source_id", "weight"), "relations")
    return store.upsert(old, new, store.KEYS["relations"])


_INC = f"""WITH {G.SIDES}, f AS (SELECT DISTINCT string_split(source_id, ':')[1] AS file FROM be WHERE source_id <> '' UNION SELECT DISTINCT string_split(source_id, ':')[1] FROM he WHERE source_id <> ''),
 o AS (SELECT string_split(source_id, ':')[1] AS file, entity_name, {_HASH.format('be')} AS h FROM be), n AS (SELECT string_split(source_id, ':')[1] AS file, entity_name, {_HASH.format('he')} AS h FROM he),
 j AS (SELECT coalesce(o.entity_name, n.entity_name) AS entity_name, CASE WHEN n.entity_name IS NULL THEN 0 WHEN o.h = n.h THEN 1 ELSE 2 END AS a FROM (SELECT * FROM o WHERE file IN (SELECT file FROM f)) o FULL JOIN (SELECT * FROM n WHERE file IN (SELECT file FROM f)) n ON o.file = n.file AND o.entity_name = n.entity_name)
 SELECT entity_name, ['delete', 'skip', 'upsert'][max(a) + 1] AS action FROM j GROUP BY 1"""


@query("incremental_actions", _INC)
def incremental_actions(spark: SparkSession, d: str) -> DataFrame:
    old, new = (G.snapshot(spark, d, w)[0].withColumn("content_hash", G.digest()) for w in ("min", "max"))
    files = old.select("source_id").union(new.select("source_id")).where("source_id <> ''").select(X.file_of(F.col("source_id")).alias("file"))
    return store.incremental_actions(old, new, files)


@query("delete_by_source", f"WITH {G.ENT} SELECT entity_name FROM e WHERE source_id IS NULL OR source_id NOT IN (SELECT source_id FROM relations WHERE source_id IS NOT NULL)")
def delete_by_source(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_by_source(G.entities(spark, d), table(spark, d, "relations").select("source_id")).select("entity_name")


@query("cascading_delete", f"WITH {G.GRAPH}, gone AS (SELECT entity_name FROM entities WHERE deleted_at IS NOT NULL) SELECT src_id, tgt_id, keywords FROM r WHERE src_id NOT IN (FROM gone) AND tgt_id NOT IN (FROM gone)")
def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return store.delete_names(e, r, table(spark, d, "entities").where("deleted_at IS NOT NULL").select("entity_name"))[1].select("src_id", "tgt_id", "keywords")


@query("source_ids", f"WITH {G.ENT} SELECT DISTINCT source_id FROM e WHERE starts_with(source_id, 'src/') ORDER BY 1")
def source_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.source_ids(G.entities(spark, d), "src/")


@query("entities_by_source", f"WITH {G.ENT} SELECT entity_name, source_id FROM e WHERE source_id IN (SELECT source_id FROM vec_node_descriptions)")
def entities_by_source(spark: SparkSession, d: str) -> DataFrame:
    return store.by_source(G.entities(spark, d), table(spark, d, "vec_node_descriptions").select("source_id")).select("entity_name", "source_id")


# history


@query("file_metrics", f"WITH {G.COMMITS} SELECT file, commits, authors, (SELECT string_agg(author, ',' ORDER BY author) FROM per WHERE per.file = fm.file) AS author_list, primary_author, bug_fixes, round(bug_fixes / commits, 9) AS bug_fix_ratio, lines_added, lines_deleted, lines_added + lines_deleted AS churn, ({G.NOW} - modified) // 86400 AS modified_days, ({G.NOW} - created) // 86400 AS age_days FROM fm")
def file_metrics(spark: SparkSession, d: str) -> DataFrame:
    return history.file_metrics(G.commits(spark, d), F.lit(G.NOW)).withColumn("bug_fix_ratio", F.round("bug_fix_ratio", 9)).withColumn("author_list", F.array_join("author_list", ","))


@query("hotspots", f"WITH {G.COMMITS} FROM hot")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return history.hotspots(history.file_metrics(G.commits(spark, d), F.lit(G.NOW)))


@query("bus_factor", f"WITH {G.COMMITS} FROM silo")
def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    c = G.commits(spark, d)
    return history.bus_factor(history.file_metrics(c, F.lit(G.NOW)), c)


@query("git_summary", f"WITH {G.COMMITS} SELECT (SELECT count(*) FROM fm) AS files, (SELECT CAST(sum(commits) AS BIGINT) FROM fm) AS changes, (SELECT count(*) FROM hot) AS hotspots, (SELECT count(*) FROM hot WHERE score >= 80) AS critical_hotspots, (SELECT count(*) FROM silo WHERE risk = 'critical') AS critical_silos")
def git_summary(spark: SparkSession, d: str) -> DataFrame:
    c = G.commits(spark, d)
    m = history.file_metrics(c, F.lit(G.NOW))
    return history.git_summary(m, history.scored(m), history.bus_factor(m, c))


@query("gitlog_commits", f"WITH {G.COMMITS} SELECT printf('%x', o_orderkey) AS sha, author, ts, count(*) AS files, CAST(sum(added) AS BIGINT) AS added FROM c GROUP BY o_orderkey, author, ts")
def gitlog_commits(spark: SparkSession, d: str) -> DataFrame:
    c = G.commits(spark, d).withColumn("sha", F.lpad("sha", 12, "0"))
    stats = F.array_join(F.transform("files", lambda f: F.concat_ws("\t", f["added"], f["deleted"], f["path"])), "\n")
    block = F.concat_ws("\n", F.concat_ws("|", "sha", "author", "ts", "message"), stats, F.lit(""))
    texts = c.groupBy(F.pmod(F.xxhash64("sha"), F.lit(64)).cast("string").alias("file")).agg(F.array_join(F.collect_list(block), "\n").alias("value"))
    got = textlogs.commits(textlogs.numbered(texts))
    return got.select(F.regexp_replace("sha", "^0+(?=.)", "").alias("sha"), "author", "ts", F.size("files").cast("bigint").alias("files"), F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s + f["added"]).alias("added"))


@query("diff_ranges", "SELECT 'src/s' || s_suppkey || '.py' AS path, CASE s_nationkey % 3 WHEN 0 THEN 'MODIFIED' WHEN 1 THEN 'ADDED' ELSE 'DELETED' END AS change_type, CASE WHEN s_nationkey % 3 = 2 THEN 0 ELSE 1 END AS added, CASE WHEN s_nationkey % 3 = 1 OR s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 4 END AS deleted_lines FROM supplier")
def diff_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    path = F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(".py"))
    mode = F.when(F.col("s_nationkey") % 3 == 1, "new file mode 100644\n").when(F.col("s_nationkey") % 3 == 2, "deleted file mode 100644\n").otherwise("")
    section = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), mode, F.lit("@@ -"), F.col("s_suppkey").cast("string"), F.lit(","), (F.col("s_suppkey") % 4).cast("string"), F.lit(" +7 @@ def x\n+text"))
    texts = s.groupBy((F.col("s_suppkey") % 16).cast("string").alias("file")).agg(F.array_join(F.collect_list(section), "\n").alias("value"))
    got = textlogs.changed_files(textlogs.numbered(texts))
    return got.select("path", "change_type", F.size("added").alias("added"), F.aggregate("deleted", F.lit(0).cast("bigint"), lambda t, r: t + r["e"] - r["s"] + 1).alias("deleted_lines"))


_DAILY = "WITH p AS (SELECT event_type AS entity, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS t, avg(value) AS y FROM events GROUP BY 1, 2), x AS (SELECT entity, y, date_diff('day', min(t) OVER (PARTITION BY entity), t) AS x, max(t) OVER (PARTITION BY entity) AS t1, min(t) OVER (PARTITION BY entity) AS t0 FROM p)"


@query("trend_regression", _DAILY + ", f AS (SELECT entity, 'value' AS metric, count(*) AS points, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, any_value(date_diff('day', t0, t1)) + 30 AS nx FROM x GROUP BY 1) SELECT entity, metric, points, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, CASE WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS direction, round(slope * nx + intercept, 6) AS forecast, slope > 0.15 AS alert FROM f")
def trend_regression(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.col("event_type").alias("entity"), F.date_trunc("day", "ts").cast("timestamp").alias("timestamp")).agg(F.avg("value").alias("v"))
    snaps = days.select("entity", F.lit("event").alias("entity_type"), "timestamp", F.create_map(F.lit("value"), F.col("v")).alias("metrics"), F.lit("main").alias("workspace"))
    t = history.trends(history.metric_points(history.dedupe_snapshots(snaps), None, "main"))
    return t.select("entity", "metric", "points", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "direction", F.round("forecast", 6).alias("forecast"), "alert")


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


# impact

_SPANS = "rg AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS e FROM lineitem), sp AS (SELECT DISTINCT l_orderkey AS k, 'L' || l_linenumber AS name, l_linenumber * 10 + 5 AS line_start, l_linenumber * 10 + 25 AS line_end FROM lineitem)"


@query("range_overlap", f"WITH {_SPANS} SELECT k AS l_orderkey, name, line_start, line_end, CAST(sum(least(e, line_end) - greatest(s, line_start) + 1) AS BIGINT) AS lines_changed FROM sp JOIN rg USING (k) WHERE line_start <= e AND s <= line_end GROUP BY ALL")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    ranges = li.select("l_orderkey", (n * 10).alias("s"), (n * 10 + F.col("l_quantity").cast("int")).alias("e"))
    spans = li.select("l_orderkey", F.concat(F.lit("L"), n.cast("string")).alias("name"), (n * 10 + 5).alias("line_start"), (n * 10 + 25).alias("line_end")).distinct()
    return impact.range_overlaps(ranges, spans, "l_orderkey")


_SRC = "regexp_extract(source_id, '^(.*):(\\d+)-(\\d+)$', {0})"
_CHANGED = f"""{G.GRAPH}, sy AS (SELECT {_SRC.format(1)} AS file, entity_name AS name, TRY_CAST({_SRC.format(2)} AS BIGINT) AS line_start, TRY_CAST({_SRC.format(3)} AS BIGINT) AS line_end FROM e WHERE regexp_matches(source_id, '^(.*):(\\d+)-(\\d+)$')),
 cf AS (SELECT DISTINCT file, CASE len(file) % 7 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'DELETED' ELSE 'MODIFIED' END AS t FROM sy),
 cs AS (SELECT file, name, 'ADDED' AS change, line_start, line_end, line_end - line_start + 1 AS lines_changed FROM sy JOIN cf USING (file) WHERE t = 'ADDED' UNION ALL SELECT file, '<deleted:' || regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '') || '>', 'DELETED', 0, 0, 0 FROM cf WHERE t = 'DELETED'
  UNION ALL SELECT file, name, 'MODIFIED', line_start, line_end, CAST(sum(least(line_end, x.e) - greatest(line_start, x.s) + 1) AS BIGINT) FROM sy JOIN cf USING (file) JOIN (VALUES (1, 40), (30, 60), (200, 210)) x(s, e) ON line_start <= x.e AND x.s <= line_end WHERE t = 'MODIFIED' GROUP BY ALL),
 q AS (SELECT DISTINCT CASE WHEN NOT ends_with(file, '.py') OR starts_with(name, replace(replace(file, '.py', ''), '/', '.') || '.') THEN name ELSE replace(replace(file, '.py', ''), '/', '.') || '.' || name END AS symbol FROM cs)"""


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, r = _er(spark, d)
    g = lambda i: F.regexp_extract("source_id", r"^(.*):(\d+)-(\d+)$", i)
    symbols = e.where(F.col("source_id").rlike(r"^(.*):(\d+)-(\d+)$")).select(g(1).alias("file"), F.col("entity_name").alias("name"), g(2).cast("bigint").alias("line_start"), g(3).cast("bigint").alias("line_end"))
    kind = F.when(F.length("file") % 7 == 0, "ADDED").when(F.length("file") % 7 == 1, "DELETED").otherwise("MODIFIED")
    span = lambda *p: F.array(*[F.struct(F.lit(a).cast("bigint").alias("s"), F.lit(b).cast("bigint").alias("e")) for a, b in p])
    files = symbols.select(F.col("file").alias("path"), kind.alias("change_type")).distinct().withColumn("added", span((1, 40), (200, 210))).withColumn("deleted", span((30, 60)))
    return impact.changed_symbols(files, symbols), r


@query("changed_symbols", f"WITH {_CHANGED} FROM cs")
def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _changed(spark, d)[0]


def _as_symbols(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Changed symbols by the names that the graph knows them by. The entities are qualified names without their files' roots, so both are asked for."""
    changed, r = _changed(spark, d)
    return impact.qualified(changed).unionByName(changed.withColumn("symbol", F.col("name"))).distinct(), r


_LOC = "regexp_extract(coalesce(source_id, ''), '^(.*):(\\d+)(-[^:]*)?$', ['file', 'line', 'rest'])"
_CALLS = f"""WITH {_CHANGED}, k AS (SELECT src_id AS caller, tgt_id, CASE WHEN x.line <> '' THEN x.file ELSE coalesce(source_id, '') END AS file, CASE WHEN x.line <> '' THEN CAST(x.line AS INTEGER) ELSE 0 END AS line
  FROM (SELECT *, {_LOC} AS x FROM r WHERE keywords = 'CALLS' AND src_id <> '' AND tgt_id <> '')), sym AS (SELECT symbol AS name FROM q UNION SELECT name FROM cs),
 d1 AS (SELECT caller, file, min(line) AS line, 1 AS distance FROM k SEMI JOIN sym ON tgt_id = name GROUP BY 1, 2),
 d2 AS (SELECT caller, file, min(line), 2 FROM k SEMI JOIN (SELECT DISTINCT caller AS c FROM d1) ON tgt_id = c ANTI JOIN d1 USING (caller, file) GROUP BY 1, 2),
 ca AS (FROM d1 UNION ALL FROM d2)"""


@query("impact_callers", f"{_CALLS} FROM ca")
def impact_callers(spark: SparkSession, d: str) -> DataFrame:
    s, r = _as_symbols(spark, d)
    return impact.callers(r, s)


_PYMOD = "regexp_replace(regexp_replace(regexp_replace(file, '\\.py$', ''), '[/\\\\]', '.', 'g'), '^\\.+', '')"


@query("affected_modules", f"{_CALLS} SELECT DISTINCT {_PYMOD} AS module FROM (SELECT file FROM ca UNION ALL SELECT file FROM cs) WHERE ends_with(file, '.py')")
def affected_modules(spark: SparkSession, d: str) -> DataFrame:
    s, r = _as_symbols(spark, d)
    return impact.affected_modules(s, impact.callers(r, s))


@query("affected_tests", f"{_CALLS} SELECT DISTINCT file FROM ca WHERE starts_with(file, 'tests/') OR starts_with(file, 'test/') OR contains(file, '/tests/') OR contains(file, '/test/') OR ends_with(file, '_test.py') OR contains(string_split(file, '/')[-1], 'test_')")
def affected_tests(spark: SparkSession, d: str) -> DataFrame:
    s, r = _as_symbols(spark, d)
    return impact.affected_tests(impact.callers(r, s))


_RISK_SYMBOLS = "(SELECT count(*) FROM (SELECT cs.*, name AS symbol FROM cs UNION SELECT cs.*, CASE WHEN NOT ends_with(file, '.py') OR starts_with(name, replace(replace(file, '.py', ''), '/', '.') || '.') THEN name ELSE replace(replace(file, '.py', ''), '/', '.') || '.' || name END FROM cs))"


@query("impact_risk", f"{_CALLS}, z AS (SELECT {_RISK_SYMBOLS} AS symbols, (SELECT count(*) FROM ca) AS callers, (SELECT count(DISTINCT {_PYMOD}) FROM (SELECT file FROM ca UNION ALL SELECT file FROM cs) WHERE ends_with(file, '.py')) AS modules, (SELECT bool_or(regexp_matches(lower(file), '(^|/)({'|'.join(X.CORE_MODULES)})[/.]')) FROM cs) AS core) SELECT *, CASE WHEN core OR callers >= 10 OR modules >= 5 THEN 'high' WHEN callers >= 3 THEN 'medium' ELSE 'low' END AS level FROM z")
def impact_risk(spark: SparkSession, d: str) -> DataFrame:
    s, r = _as_symbols(spark, d)
    return impact.risk(s, impact.callers(r, s), 0.8).select("symbols", "callers", "modules", "core", "level")


# debt

_ISSUES = f"""WITH {G.TOPOLOGY}, {_SCORE}, {G.COMMITS}, iss AS (SELECT 'topology' AS source, CASE reason WHEN 'neighbors_unresolved' THEN 'P2' ELSE 'P1' END AS severity, 'orphan_entity' AS category, entity, type AS entity_type, source_id AS file FROM o
 UNION ALL SELECT 'topology', 'P1', 'hub_fragility', entity, type, source_id FROM hub
 UNION ALL SELECT 'topology', CASE WHEN regexp_matches(entity, '^(?:{"|".join(X.INTRICATE_FUNCTIONS)})') THEN 'P1' ELSE 'P0' END, 'god_function', entity, type, source_id FROM god
 UNION ALL SELECT 'topology', 'P2', 'placeholder_module', module, 'module', '' FROM (SELECT module FROM m JOIN a USING (entity_name) WHERE source_id <> '' GROUP BY module HAVING bool_and(ends_with(entity_name, '__init__')))
 UNION ALL SELECT 'topology', 'P1', 'coupling_density', 'cross-module', 'system', '' FROM ts WHERE density > 0.5
 UNION ALL SELECT 'git', 'P0', 'critical_hotspot', file, 'file', file FROM hot WHERE score >= 80 UNION ALL SELECT 'git', 'P1', 'knowledge_silo', file, 'file', file FROM silo WHERE risk = 'critical')"""


def _git(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, hotspots, silos) of the commits."""
    c = G.commits(spark, d)
    m = Scratch(spark).cut(history.file_metrics(c, F.lit(G.NOW)))
    return m, history.scored(m), history.bus_factor(m, c)


def _issues(spark: SparkSession, d: str) -> tuple[DataFrame, graph.Topology, DataFrame]:
    t, (m, hot, silos) = _topology(spark, d), _git(spark, d)
    return debt.topology_issues(t).unionByName(debt.git_issues(hot, silos)), t, m


@query("debt_issues", _ISSUES + " FROM iss")
def debt_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)[0].select(*debt.ISSUE)


@query("debt_numbered", _ISSUES + " SELECT printf('debt-%03d', row_number() OVER (ORDER BY source, severity, category, entity, file)) AS id, * FROM iss")
def debt_numbered(spark: SparkSession, d: str) -> DataFrame:
    return debt.numbered(_issues(spark, d)[0].select(*debt.ISSUE))


@query("debt_details", _ISSUES + """ SELECT category, entity, file, CASE category WHEN 'orphan_entity' THEN CASE severity WHEN 'P2' THEN 'low' ELSE 'medium' END END AS confidence,
 CASE category WHEN 'hub_fragility' THEN (SELECT CAST(max(degree) AS DOUBLE) FROM hub WHERE hub.entity = iss.entity) WHEN 'god_function' THEN (SELECT CAST(max(degree) AS DOUBLE) FROM god WHERE god.entity = iss.entity)
 WHEN 'coupling_density' THEN (SELECT density FROM ts) WHEN 'critical_hotspot' THEN (SELECT CAST(max(score) AS DOUBLE) FROM hot WHERE hot.file = iss.file) WHEN 'knowledge_silo' THEN (SELECT CAST(max(commits) AS DOUBLE) FROM silo WHERE silo.file = iss.file) WHEN 'orphan_entity' THEN 0.0 END AS figure FROM iss WHERE category <> 'placeholder_module'""")
def debt_details(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metrics")
    figure = F.when(F.col("category") == "hub_fragility", m["in_degree"]).when(F.col("category") == "god_function", m["out_degree"]).when(F.col("category") == "coupling_density", m["density"]).when(F.col("category") == "critical_hotspot", m["score"]).when(F.col("category") == "knowledge_silo", m["commits"]).when(F.col("category") == "orphan_entity", m["in_degree"])
    return _issues(spark, d)[0].where("category <> 'placeholder_module'").select("category", "entity", "file", "confidence", figure.alias("figure"))


@query("debt_counts", _ISSUES + " SELECT source, severity, count(*) AS n FROM iss GROUP BY ALL")
def debt_counts(spark: SparkSession, d: str) -> DataFrame:
    return debt.issue_counts(_issues(spark, d)[0])


@query("git_score", f"WITH {G.COMMITS} SELECT 100 - least(40, 15 * (SELECT count(*) FROM hot WHERE score >= 80)) - least(40, 8 * (SELECT count(*) FROM silo WHERE risk = 'critical')) AS git_score")
def git_score(spark: SparkSession, d: str) -> DataFrame:
    return debt.git_score(*_git(spark, d)[1:])


@query("debt_health", _ISSUES + ", n AS (SELECT count(*) FILTER (WHERE severity = 'P0') AS p0, count(*) FILTER (WHERE severity = 'P1') AS p1, count(*) FILTER (WHERE severity = 'P2') AS p2, 100.0::DOUBLE AS quality, CAST(NULL AS DOUBLE) AS maintainability, (SELECT score::DOUBLE FROM ts) AS structure FROM iss), h AS (SELECT *, CAST(trunc(round((quality * 0.4 + structure * 0.3) / 0.7, 9)) AS INTEGER) AS total FROM n) SELECT *, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END AS grade FROM h")
def debt_health(spark: SparkSession, d: str) -> DataFrame:
    issues, t, _ = _issues(spark, d)
    return debt.health(issues, t.score())


@query("debt_enriched", _ISSUES + ", j AS (SELECT iss.*, fm.commits AS fc, (1900000000 - modified) // 86400 AS md FROM iss LEFT JOIN fm ON fm.file = regexp_replace(iss.file, ':[0-9-][^:]*$', '')) SELECT source, CASE WHEN category = 'god_function' AND fc > 10 THEN 'P0' ELSE severity END AS severity, category, entity, entity_type, file, CASE WHEN category = 'orphan_entity' AND md IS NOT NULL THEN CASE WHEN md > 365 THEN 'high' WHEN md > 90 THEN 'medium' ELSE 'low' END WHEN category = 'orphan_entity' THEN CASE j.severity WHEN 'P2' THEN 'low' ELSE 'medium' END END AS confidence, coalesce(category = 'god_function' AND fc > 10, false) AS is_hotspot FROM j")
def debt_enriched(spark: SparkSession, d: str) -> DataFrame:
    issues, _, m = _issues(spark, d)
    return debt.enriched(issues, m).select(*debt.ISSUE, "confidence", "is_hotspot")


# search


@query("find_exact", f"WITH {G.ENT} SELECT entity_name AS entity, entity_type AS type, source_id, substr(coalesce(description, ''), 1, 200) AS description, CAST(CASE WHEN lower(entity_name) = 'reader' THEN 1.0 ELSE 0.9 END AS DOUBLE) AS score FROM e WHERE contains(lower(entity_name), 'reader')")
def find_exact(spark: SparkSession, d: str) -> DataFrame:
    return search.find_exact(G.entities(spark, d), "Reader")


@query("find_top", None)
def find_top(spark: SparkSession, d: str) -> DataFrame:
    return search.find(G.entities(spark, d), "LoaderMapper")


@query("similar_names", None)
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    base, head = G.snapshot(spark, d, "min"), G.snapshot(spark, d, "max")
    name = base[0].where("entity_type = 'method'").agg(F.min("entity_name")).first()[0] or "main"
    return search.similar({"base": base, "head": head}, name)


@query("name_similarity", None)
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_name").distinct()
    return p.select("p_name", matching_ratio(F.lit("almond antique blue"), F.col("p_name")).alias("ratio"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [1.0]


_Q0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


@query("knn_topk", f"SELECT vec_id, label, round(list_distance(CAST(embedding AS DOUBLE[]), {_Q0}), 6) AS distance FROM embeddings WHERE len(embedding) = len({_Q0}) ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_Q0}), vec_id LIMIT 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(table(spark, d, "embeddings"), _query_vector(spark, d), 10, key="vec_id").withColumn("distance", F.round("distance", 6))


@query("vector_search", f"WITH {G.ENT}, v AS (SELECT entity_name, source_id, list_distance(CAST(embedding AS DOUBLE[]), {_Q0}) AS d FROM vec_node_descriptions WHERE len(embedding) = len({_Q0}) AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL), true) AND NOT list_contains(list_transform(embedding, lambda x: isnan(x) OR isinf(x)), true) QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY vec_id DESC) = 1) SELECT v.entity_name AS entity, coalesce(entity_type, '') AS type, round(d, 6) AS distance FROM v LEFT JOIN e USING (entity_name) ORDER BY d, v.entity_name LIMIT 20")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vec_node_descriptions")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = v.where((F.size("embedding") == len(_query_vector(spark, d))) & fine).groupBy("entity_name").agg(F.max(F.struct("vec_id", "embedding", "source_id")).alias("r")).select("entity_name", "r.embedding", "r.source_id")
    near = search.knn(rows, _query_vector(spark, d), 20)
    info = G.entities(spark, d).select("entity_name", "entity_type")
    return near.join(info, "entity_name", "left").select(F.col("entity_name").alias("entity"), X.text(F.col("entity_type")).alias("type"), F.round("distance", 6).alias("distance"))


@query("vectors_normalised", "SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm2, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings)")
def vectors_normalised(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "embeddings").select("vec_id", search.normalised(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.round(F.col("u")[0], 6).alias("first"))


@query("embed_backfill", f"WITH {G.ENT} SELECT entity_name, source_id, 64 AS dims FROM e WHERE description <> '' AND entity_name NOT IN (SELECT entity_name FROM vec_node_descriptions WHERE entity_name IS NOT NULL)")
def embed_backfill(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "vec_node_descriptions").where("entity_name IS NOT NULL").select("entity_name").distinct()
    out = search.embed_entities(G.entities(spark, d), search.hash_embedder(64), known=known)
    return out.select("entity_name", "source_id", F.size("embedding").alias("dims"))


# sources


def _records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select(F.to_json(F.struct(F.lit("entity").alias("type"), F.col("entity_name").alias("id"), "entity_type", "source_id", "description", F.lit("ast").alias("provenance"))).alias("line"))
    r = table(spark, d, "relations").select(
        F.to_json(F.struct(F.lit("edge").alias("type"), F.col("keywords").alias("kind"), F.col("src_id").alias("src"), F.when(F.col("resolution_qualifier") == "resolved", F.col("tgt_id")).alias("dst"), "dst_raw", "candidates", "resolution_qualifier", "source_id", "ord")).alias("line")
    )
    return ndjson.parse(e.unionByName(r))


@query("ndjson_entities", "SELECT entity_name, entity_type, coalesce(description, '') AS description, source_id, string_split(source_id, ':')[1] AS file_path FROM entities WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL AND source_id IS NOT NULL")
def ndjson_entities(spark: SparkSession, d: str) -> DataFrame:
    return ndjson.entities(_records(spark, d)).select("entity_name", "entity_type", "description", "source_id", "file_path")


_TARGET = "CASE WHEN resolution_qualifier = 'resolved' THEN nullif(tgt_id, '') WHEN resolution_qualifier IN ('ambiguous', 'unresolved') THEN nullif(dst_raw, '') END"


@query("ndjson_relations", f"SELECT src_id, {_TARGET} AS tgt_id, keywords, source_id, CAST(CASE WHEN resolution_qualifier = 'resolved' THEN 1.0 ELSE 0.5 END AS DOUBLE) AS weight, resolution_qualifier FROM relations WHERE {_TARGET} IS NOT NULL AND source_id IS NOT NULL AND src_id IS NOT NULL AND keywords IS NOT NULL")
def ndjson_relations(spark: SparkSession, d: str) -> DataFrame:
    return ndjson.relations(_records(spark, d)).select("src_id", "tgt_id", "keywords", "source_id", "weight", "resolution_qualifier")


@query("ndjson_summary", f"WITH x AS (SELECT entity_type, source_id FROM entities WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL AND source_id IS NOT NULL), y AS (SELECT keywords, resolution_qualifier, source_id FROM relations WHERE {_TARGET} IS NOT NULL AND source_id IS NOT NULL), tf AS (SELECT 'e' AS k, lower(source_id) AS s FROM x UNION ALL SELECT 'r', lower(source_id) FROM y), tt AS (SELECT k, contains(s, '.test.') OR contains(s, '.spec.') OR contains(s, '__tests__') OR contains(s, '/tests/') OR contains(s, '\\tests\\') OR starts_with(regexp_extract(s, '([^/\\\\]*)$', 1), 'test_') OR ends_with(s, '_test.py') AS t FROM tf) SELECT 'entity_type' AS what, entity_type AS value, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'edge_kind', keywords, count(*) FROM y GROUP BY ALL UNION ALL SELECT 'edge_qualifier', resolution_qualifier, count(*) FROM y GROUP BY ALL UNION ALL SELECT CASE k WHEN 'e' THEN 'entity_test' ELSE 'edge_test' END, CAST(t AS VARCHAR), count(*) FROM tt GROUP BY ALL")
def ndjson_summary(spark: SparkSession, d: str) -> DataFrame:
    return ndjson.summary(_records(spark, d))


@query("ndjson_verdicts", f"SELECT CASE WHEN source_id IS NULL OR entity_type IS NULL THEN 'skipped' ELSE 'stored' END AS verdict, 'entity' AS type, count(*) AS n FROM entities GROUP BY ALL UNION ALL SELECT CASE WHEN resolution_qualifier IS NULL OR source_id IS NULL THEN 'skipped' WHEN resolution_qualifier = 'unresolved' AND coalesce(dst_raw, '') = '' THEN 'dropped' WHEN {_TARGET} IS NULL THEN 'skipped' ELSE 'stored' END, 'edge', count(*) FROM relations GROUP BY ALL")
def ndjson_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return ndjson.verdicts(_records(spark, d))


@query("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _foreign(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("class", "function", "method", "import", "file")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    nodes = p.select(F.col("p_partkey").cast("string").alias("id"), kinds.alias("kind"), F.concat_ws(".", "p_brand", F.col("p_partkey") % 50).alias("qualified_name"), F.concat(F.lit("src/"), F.col("p_partkey") % 90, F.lit(".ts")).alias("file_path"), F.col("p_size").alias("start_line"), F.col("p_size").alias("end_line"), F.lit("").alias("docstring"), F.col("p_name").alias("signature"), F.col("p_partkey").alias("updated_at"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    ekind = F.element_at(F.array(*[F.lit(k) for k in ("calls", "imports", "contains", "extends")]), F.col("l_linenumber") % 4 + 1)
    edges = li.select(F.col("l_partkey").cast("string").alias("source"), F.col("l_suppkey").cast("string").alias("target"), ekind.alias("kind"), F.col("l_linenumber").alias("line"), F.lit("x").alias("provenance"))
    return nodes, edges


_FOREIGN = """nd AS (SELECT CAST(p_partkey AS VARCHAR) AS id, ['class', 'function', 'method', 'import', 'file'][p_partkey % 5 + 1] AS kind, p_brand || '.' || (p_partkey % 50) AS qn, 'src/' || (p_partkey % 90) || '.ts' AS fp, p_size, p_name FROM part),
 kn AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY qn) > 1 THEN fp || '::' || qn ELSE qn END AS name FROM nd WHERE kind <> 'import')"""


@query("foreign_entities", f"WITH {_FOREIGN} SELECT name AS entity_name, kind AS entity_type, p_name AS description, fp || ':' || p_size AS source_id FROM kn")
def foreign_entities(spark: SparkSession, d: str) -> DataFrame:
    return foreign.entities(_foreign(spark, d)[0]).select("entity_name", "entity_type", "description", "source_id")


@query("foreign_relations", f"WITH {_FOREIGN}, li AS (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem) SELECT s.name AS src_id, coalesce(t.name, nd.qn, '<unresolved>') AS tgt_id, ['CALLS', 'IMPORTS', '', 'INHERITS'][l_linenumber % 4 + 1] AS keywords, s.name || ':' || l_linenumber AS source_id, CAST(CASE WHEN t.name IS NULL THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight, CASE WHEN t.name IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution_qualifier FROM li JOIN kn s ON s.id = CAST(l_partkey AS VARCHAR) LEFT JOIN kn t ON t.id = CAST(l_suppkey AS VARCHAR) LEFT JOIN nd ON nd.id = CAST(l_suppkey AS VARCHAR) WHERE l_linenumber % 4 <> 2")
def foreign_relations(spark: SparkSession, d: str) -> DataFrame:
    return foreign.relations(*_foreign(spark, d)).select("src_id", "tgt_id", "keywords", "source_id", "weight", "resolution_qualifier")


@query("foreign_fingerprint", "SELECT (SELECT count(*) FROM part) || '/' || (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem)) || '/' || (SELECT max(p_partkey) FROM part) AS fingerprint")
def foreign_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return foreign.fingerprint(*_foreign(spark, d))


