"""Further queries over whole tables: workspaces, reports, scopes, names, classes and batches of query vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators import debt, diffs, graph, history, search, store, traverse
from quarrygraph.plans import graphs as G
from quarrygraph.plans.registry import query
from quarrygraph.session import shared_folder, table
from quarrygraph.sources import ndjson, reports, textlogs


def _er(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.entities(spark, d), G.relations(spark, d)


# workspaces: everything is written to one in the shared folder and read back


def _workspace(spark: SparkSession) -> store.Workspace:
    return store.Workspace(spark, f"{shared_folder(spark)}/quarry-workspaces", uuid.uuid4().hex)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries of entities as interchange lines; ``seq`` is the order in which they came."""
    e = table(spark, d, "entities")
    line = F.to_json(F.struct(F.lit("entity").alias("type"), F.col("entity_name").alias("id"), "entity_type", "source_id", "description", F.lit("ast").alias("provenance")))
    return ndjson.parse(e.select(line.alias("line"), F.struct("indexed_at", "entity_type", "description", "source_id").alias("seq")))


@query(
    "ndjson_last_wins",
    "SELECT entity_name, entity_type, coalesce(description, '') AS description, source_id FROM entities WHERE entity_name <> '' AND entity_type IS NOT NULL AND source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY indexed_at DESC NULLS LAST, entity_type DESC, description DESC NULLS LAST, source_id DESC) = 1",
)
def ndjson_last_wins(spark: SparkSession, d: str) -> DataFrame:
    w = _workspace(spark)
    w.write(ndjson.entities(_lines(spark, d)))
    return w.table("entities").select("entity_name", "entity_type", "description", "source_id")


_HASH = "CASE WHEN json_valid(properties_json) THEN json_extract_string(properties_json, '$.content_hash') END"
_OLD = """e0 AS (SELECT * FROM entities_mirror WHERE entity_name <> '' QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY indexed_at DESC NULLS LAST, entity_type DESC NULLS LAST, description DESC NULLS LAST, source_id DESC NULLS LAST, properties_json DESC NULLS LAST) = 1),
 r0 AS (SELECT * FROM (SELECT * FROM relations_mirror WHERE ord IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord ORDER BY indexed_at DESC NULLS LAST, src_id DESC, tgt_id DESC, keywords DESC, source_id DESC NULLS LAST) = 1) WHERE src_id <> '' AND tgt_id <> '' QUALIFY row_number() OVER (PARTITION BY src_id, tgt_id, keywords ORDER BY ord DESC) = 1)"""
# files of an even number of letters count as changed
_AFTER = f"""WITH {G.GRAPH}, {_OLD}, o AS (SELECT string_split(source_id, ':')[1] AS file, entity_name, {_HASH} AS h FROM e0 WHERE len(string_split(source_id, ':')[1]) % 2 = 0), n AS (SELECT string_split(source_id, ':')[1] AS file, entity_name, {_HASH} AS h FROM e WHERE len(string_split(source_id, ':')[1]) % 2 = 0),
 j AS (SELECT coalesce(o.entity_name, n.entity_name) AS entity_name, max(CASE WHEN n.entity_name IS NULL THEN 0 WHEN o.h = n.h THEN 1 ELSE 2 END) AS a FROM o FULL JOIN n ON o.file = n.file AND o.entity_name = n.entity_name GROUP BY 1),
 gone AS (SELECT entity_name FROM j WHERE a = 0), up AS (SELECT entity_name FROM j WHERE a = 2),
 ents AS (SELECT entity_name, entity_type, source_id FROM e0 WHERE entity_name NOT IN (FROM gone) AND entity_name NOT IN (FROM up) UNION ALL SELECT entity_name, entity_type, source_id FROM e WHERE entity_name IN (FROM up)),
 rn AS (SELECT src_id, tgt_id, keywords, ord FROM r WHERE src_id <> '' AND tgt_id <> '' AND len(string_split(source_id, ':')[1]) % 2 = 0),
 rels AS (SELECT src_id, tgt_id, keywords, ord FROM r0 WHERE src_id NOT IN (FROM gone) AND tgt_id NOT IN (FROM gone) AND (src_id, tgt_id, keywords) NOT IN (SELECT (src_id, tgt_id, keywords) FROM rn) UNION ALL FROM rn)"""


def _changed_workspace(spark: SparkSession, d: str) -> store.Workspace:
    from quarrygraph.operators.counted import counted

    w = _workspace(spark)
    old = counted(table(spark, d, "entities_mirror"), ["entity_name"], "indexed_at", G.ENTITY).withColumn("content_hash", G.digest())
    links = counted(table(spark, d, "relations_mirror"), ["ord"], "indexed_at", [*G.EDGE, "source_id"])
    w.ingest(old, links)
    e, r = _er(spark, d)
    e = e.withColumn("content_hash", G.digest())
    file = X.file_of(F.col("source_id")).alias("file")
    files = old.select(file).union(e.select(file)).union(r.select(file)).where(F.length("file") % 2 == 0)
    w.ingest_changes(e, r, files)
    return w


@query("ingest_changes_state", f"{_AFTER} FROM ents")
def ingest_changes_state(spark: SparkSession, d: str) -> DataFrame:
    return _changed_workspace(spark, d).table("entities").select("entity_name", "entity_type", "source_id")


@query("ingest_changes_relations", f"{_AFTER} FROM rels")
def ingest_changes_relations(spark: SparkSession, d: str) -> DataFrame:
    return _changed_workspace(spark, d).table("relations").select("src_id", "tgt_id", "keywords", "ord")


@query("ingest_changes_ratio", f"WITH {G.GRAPH} SELECT 'resolved_ratio' AS key, CAST(round(count(*) FILTER (WHERE src_id IN (SELECT entity_name FROM e) AND tgt_id IN (SELECT entity_name FROM e)) / count(*), 4) AS VARCHAR) AS value FROM r")
def ingest_changes_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _changed_workspace(spark, d).table("meta").where("key = 'resolved_ratio'").select("key", "value")


_VECTORS = "v AS (SELECT entity_name, embedding FROM vec_node_descriptions WHERE entity_name IS NOT NULL AND len(embedding) = 64 QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY vec_id DESC) = 1)"


@query("vector_count", f"WITH {_VECTORS} SELECT count(*) AS vectors FROM v")
def vector_count(spark: SparkSession, d: str) -> DataFrame:
    w = _workspace(spark)
    w.write_embeddings(table(spark, d, "vec_node_descriptions"), 64)
    return spark.createDataFrame([(w.vector_count(),)], "vectors bigint")


@query("workspace_clear", "SELECT 'entities' AS tab, 0::BIGINT AS n UNION ALL SELECT 'relations', 0 UNION ALL SELECT 'meta', 2")
def workspace_clear(spark: SparkSession, d: str) -> DataFrame:
    w = _workspace(spark)
    w.ingest(*_er(spark, d), provider="p")
    w.clear()
    parts = [w.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tab"), "n") for t in ("entities", "relations", "meta")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# interchange


@query("ndjson_meta", "SELECT CAST(n_nationkey AS INTEGER) AS schema_version, n_name AS generator, CAST(NULL AS VARCHAR) AS provenance_completeness FROM nation ORDER BY n_nationkey DESC LIMIT 1")
def ndjson_meta(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return ndjson.meta(ndjson.parse(n.select(F.to_json(F.struct(F.lit("meta").alias("type"), F.col("n_nationkey").cast("int").alias("schema_version"), F.col("n_name").alias("generator"))).alias("line"), F.struct("n_nationkey").alias("seq"))))


_IS_TEST = "(contains(s, '.test.') OR contains(s, '.spec.') OR contains(s, '__tests__') OR contains(s, '/tests/') OR contains(s, '\\tests\\') OR starts_with(regexp_extract(s, '([^/\\\\]*)$', 1), 'test_') OR ends_with(s, '_test.py'))"


@query("ndjson_test_ratios", f"WITH s AS (SELECT lower(source_id) AS s FROM entities WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL AND source_id IS NOT NULL) SELECT count(*) AS entities, 0::BIGINT AS relations, round(count(*) FILTER (WHERE {_IS_TEST}) / count(*), 4) AS entity_test_ratio, 0.0::DOUBLE AS relation_test_ratio FROM s")
def ndjson_test_ratios(spark: SparkSession, d: str) -> DataFrame:
    return ndjson.test_ratios(_lines(spark, d))


@query("ndjson_warnings", "SELECT 'bad JSON' AS warning, count(*) AS n FROM documents WHERE starts_with(text, '{') AND NOT json_valid(text) AND NOT contains(text, chr(10)) HAVING count(*) > 0 UNION ALL SELECT 'entity: missing required field', count(*) FROM entities WHERE entity_name IS NULL OR entity_type IS NULL OR source_id IS NULL HAVING count(*) > 0 UNION ALL SELECT 'no meta record', 1")
def ndjson_warnings(spark: SparkSession, d: str) -> DataFrame:
    return ndjson.warnings(_lines(spark, d)).where("warning IN ('entity: missing required field', 'no meta record', 'bad JSON')")


@query("warning_lines", "SELECT DISTINCT 'parser missing: ' || lower(n_name) AS warning FROM nation WHERE regexp_matches(n_name, '^\\w+$') UNION SELECT DISTINCT 'WARNING: ' || r_name FROM region")
def warning_lines(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where(F.col("n_name").rlike(r"^\w+$")).select(F.concat(F.lit(" Parser library not installed for "), "n_name").alias("line"))
    r = table(spark, d, "region").select(F.concat(F.lit("WARNING: "), "r_name").alias("line"))
    return textlogs.warning_lines(n.union(r).union(n).union(r.select(F.concat(F.lit("info "), "line"))))


@query("changed_listing", "SELECT DISTINCT string_split(source_id, ':')[1] AS file FROM relations WHERE regexp_matches(string_split(source_id, ':')[1], '\\.py$') AND string_split(source_id, ':')[1] IN (SELECT string_split(source_id, ':')[1] FROM entities)")
def changed_listing(spark: SparkSession, d: str) -> DataFrame:
    status = table(spark, d, "relations").where("source_id <> ''").select(F.concat(F.when(F.col("ord") % 2 == 0, " M ").otherwise("R  old.py -> "), X.file_of(F.col("source_id"))).alias("line"))
    return textlogs.listing(status, [".py"], table(spark, d, "entities").select(X.file_of(F.col("source_id")).alias("file")))


# reports


def _report(spark: SparkSession, d: str) -> DataFrame:
    """A static report of all parts, one document per brand, written as JSON and read back."""
    p = table(spark, d, "part").withColumn("path", F.format_string("src/p%d/m%d.py", F.col("p_partkey") % 7, F.col("p_partkey")))
    n = F.col("p_size").cast("int")
    doc = p.groupBy("p_brand").agg(
        F.collect_list(F.when(n > 40, F.struct("path", (n * 50).alias("lines"), F.when(n > 45, "critical").alias("severity")))).alias("giant_files"),
        F.collect_list(F.when(n % 5 == 0, F.struct("path", F.col("p_name").alias("function_name"), n.alias("lines"), F.when(n % 2 == 0, n).alias("complexity")))).alias("giant_functions"),
        F.collect_list(F.when(n % 11 == 3, F.struct("path", F.lit("sleep").alias("type"), n.alias("line_number")))).alias("test_smells"),
        F.collect_list(F.when(n % 3 > 0, F.struct("path", (n / 5).alias("score")))).alias("maintainability_scores"),
        F.collect_list(F.struct(F.col("path").alias("file_path"), F.array(F.struct(F.when(n % 2 == 0, "large_file").otherwise("naming_violation").alias("category")), F.struct(F.when(n % 3 == 0, "low_comment_ratio").otherwise("other").alias("category"))).alias("issues"))).alias("file_reports"),
    )
    path = f"{shared_folder(spark)}/quarry-reports/{uuid.uuid4().hex}"
    doc.select(F.to_json(F.struct(*[c for c in doc.columns if c != "p_brand"])).alias("value")).repartition(8).write.text(path)
    return reports.read_report_lines(spark, path)


_PART = "p AS (SELECT *, 'src/p' || (p_partkey % 7) || '/m' || p_partkey || '.py' AS path, 'm' || p_partkey || '.py' AS base, CAST(p_size AS INTEGER) AS n FROM part)"
_STATIC = f"""{_PART}, st AS (SELECT path, CASE WHEN n > 45 THEN 'P0' ELSE 'P1' END AS severity, 'god_class' AS category, base AS entity, 'file' AS entity_type, CAST(n * 50 AS DOUBLE) AS figure FROM p WHERE n > 40
 UNION ALL SELECT path, 'P1', 'god_function', p_name, 'function', CAST(CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS DOUBLE) FROM p WHERE n % 5 = 0 UNION ALL SELECT path, 'P2', 'test_smell', base, 'file', CAST(n AS DOUBLE) FROM p WHERE n % 11 = 3)"""


def _static(issues: DataFrame) -> DataFrame:
    m = F.col("metrics")
    return issues.select(F.col("file").alias("path"), "severity", "category", "entity", "entity_type", F.when(F.col("category") == "god_class", m["lines"]).when(F.col("category") == "god_function", m["complexity"]).otherwise(m["start_line"]).alias("figure"))


@query("static_issues", f"WITH {_STATIC} FROM st")
def static_issues(spark: SparkSession, d: str) -> DataFrame:
    return _static(debt.static_issues(_report(spark, d)))


@query("static_issues_scoped", f"WITH {_STATIC} FROM st WHERE starts_with(path, 'src/p3/')")
def static_issues_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _static(debt.static_issues(_report(spark, d), "src/p3"))


@query("static_maintainability", f"WITH {_PART} SELECT round(avg(n / 5) * 10, 6) AS maintainability FROM p WHERE n % 3 > 0")
def static_maintainability(spark: SparkSession, d: str) -> DataFrame:
    return debt.maintainability(_report(spark, d)).select(F.round("maintainability", 6).alias("maintainability"))


@query("maintainability_by_file", f"WITH {_STATIC} SELECT category, entity, path AS file, CASE WHEN n % 3 > 0 THEN n / 5 ELSE 5.0 END AS maintainability FROM st JOIN p USING (path)")
def maintainability_by_file(spark: SparkSession, d: str) -> DataFrame:
    r = _report(spark, d)
    return debt.with_maintainability(debt.static_issues(r), r).select("category", "entity", "file", "maintainability")


@query("report_breakdown", f"WITH {_PART} SELECT path AS file, CAST(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS file_size, CAST(CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS comment_ratio, CAST(CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS naming FROM p")
def report_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return debt.breakdown(_report(spark, d))


@query(
    "debt_health_static",
    f"""WITH {_STATIC}, {G.COMMITS}, g AS (SELECT 100 - least(40, 15 * (SELECT count(*) FROM hot WHERE hot.score >= 80)) - least(40, 8 * (SELECT count(*) FROM silo WHERE risk = 'critical')) AS git),
 k AS (SELECT count(*) FILTER (WHERE severity = 'P0') AS p0, count(*) FILTER (WHERE severity = 'P1') AS p1, count(*) FILTER (WHERE severity = 'P2') AS p2 FROM st),
 h AS (SELECT p0, p1, p2, CAST(greatest(0, 100 - 10 * p0 - 5 * p1 - p2) AS DOUBLE) AS quality, (SELECT avg(n / 5) * 10 FROM p WHERE n % 3 > 0) AS maintainability, CAST(git AS DOUBLE) AS structure FROM k, g),
 t AS (SELECT *, CAST(trunc(round(quality * 0.4 + maintainability * 0.3 + structure * 0.3, 9)) AS INTEGER) AS total FROM h)
 SELECT p0, p1, p2, quality, round(maintainability, 6) AS maintainability, structure, total, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END AS grade FROM t""",
)
def debt_health_static(spark: SparkSession, d: str) -> DataFrame:
    r, c = _report(spark, d), G.commits(spark, d)
    m = history.file_metrics(c, F.lit(G.NOW))
    git = debt.git_score(history.scored(m), history.bus_factor(m, c))
    h = debt.health(debt.static_issues(r), spark.createDataFrame([(100,)], "score int"), debt.maintainability(r), git)
    return h.withColumn("maintainability", F.round("maintainability", 6))


# scopes, orders and types


@query("topology_module_hubs", f"WITH {G.TOPOLOGY} SELECT entity, type, source_id, degree AS in_degree FROM hub WHERE starts_with(source_id, 'src/')")
def topology_module_hubs(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.Topology(r, e, module="src").ordered_hubs()


@query("topology_scope_orphans", f"WITH {G.TOPOLOGY} SELECT entity, type, source_id, reason FROM o WHERE starts_with(source_id, 'src/lavaka')")
def topology_scope_orphans(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.Topology(r, e, scope="src/lavaka").orphans()


@query("gods_ranked", f"WITH {G.TOPOLOGY} SELECT row_number() OVER (ORDER BY degree DESC, entity) AS rank, entity, degree AS out_degree FROM god")
def gods_ranked(spark: SparkSession, d: str) -> DataFrame:
    from quarrygraph.operators.ranks import ranked

    e, r = _er(spark, d)
    return ranked(graph.Topology(r, e).ordered_gods(), [F.desc("out_degree"), F.asc("entity")]).select("rank", "entity", "out_degree")


_KEPT = "entity_name IN (SELECT entity_name FROM a)"


@query("store_topology_gods", f"WITH {G.TOPOLOGY} SELECT src AS entity, entity_type AS type, source_id, count(*) AS degree FROM re JOIN e ON entity_name = src WHERE {_KEPT} AND coalesce(entity_type, '') NOT IN ('module', 'file') AND starts_with(coalesce(source_id, ''), 'src/') GROUP BY ALL HAVING count(*) >= 10")
def store_topology_gods(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.store_topology(r, e, prefix="src/")["gods"]


@query("resolution_caveat", f"WITH {G.GRAPH}, x AS (SELECT round(count(*) FILTER (WHERE src_id IN (SELECT entity_name FROM e) AND tgt_id IN (SELECT entity_name FROM e)) / count(*), 4) AS ratio FROM r) SELECT ratio, CASE WHEN ratio < 0.5 THEN 'edge resolution ratio ' || printf('%.1f%%', ratio * 100) || ' is below 50%: orphans and the score may tell of unresolved edges, not of dead code' END AS caveat FROM x")
def resolution_caveat(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    return graph.resolution(r, e).select("ratio", graph.resolution_caveat(F.col("ratio")).alias("caveat"))


@query("placeholder_modules_of_suppliers", "SELECT 'src/n' || s_nationkey AS module, count(*) AS entities FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY s_nationkey")
def placeholder_modules_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("n"), "s_nationkey", F.lit(".s"), "s_suppkey", F.when((F.col("s_nationkey") % 3 == 0) | (F.col("s_suppkey") % 2 == 0), ".__init__").otherwise(".run"))
    only = s.where("s_nationkey % 3 <> 0").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("s_suppkey")).select(F.concat(F.lit("n"), "s_nationkey", F.lit(".last")).alias("entity_name"), "s_nationkey", "s_suppkey")
    rows = s.select(name.alias("entity_name"), "s_nationkey", "s_suppkey").unionByName(only)
    return graph.placeholder_modules(rows.select("entity_name", F.lit("function").alias("entity_type"), F.format_string("src/n%d/m%d.py:1", "s_nationkey", "s_suppkey").alias("source_id")))


@query("new_chains_back", f"WITH {G.BRANCH} SELECT src, tgt, kind FROM ch WHERE change = 'removed' AND src IN (SELECT entity_name FROM he)")
def new_chains_back(spark: SparkSession, d: str) -> DataFrame:
    """From the last snapshot back to the first: what was lost on the way there is new."""
    return diffs.BranchDiff(*G.snapshot(spark, d, "max"), *G.snapshot(spark, d, "min")).new_chains()


@query("branch_unresolved", f"WITH {G.SIDES} SELECT (SELECT count(*) FROM br WHERE src_id <> '' AND tgt_id <> '' AND NOT (src_id IN (SELECT entity_name FROM be) AND tgt_id IN (SELECT entity_name FROM be))) AS base_unresolved_edges, (SELECT count(*) FROM hr WHERE src_id <> '' AND tgt_id <> '' AND NOT (src_id IN (SELECT entity_name FROM he) AND tgt_id IN (SELECT entity_name FROM he))) AS head_unresolved_edges")
def branch_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return diffs.BranchDiff(*G.snapshot(spark, d, "min"), *G.snapshot(spark, d, "max")).unresolved()


@query("silos_ranked", f"WITH {G.COMMITS} SELECT row_number() OVER (ORDER BY list_position(['critical', 'high', 'medium', 'informational'], risk), commits DESC, file) AS rank, file, risk, commits FROM silo")
def silos_ranked(spark: SparkSession, d: str) -> DataFrame:
    from quarrygraph.operators.ranks import ranked

    c = G.commits(spark, d)
    found = history.bus_factor(history.file_metrics(c, F.lit(G.NOW)), c)
    return ranked(found, [history.risk_order(), F.desc("commits"), F.asc("file")]).select("rank", "file", "risk", "commits")


@query("trend_points_window", "SELECT event_type AS entity, CAST(ts AS DATE) AS day, count(*) AS points FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 DAY AND hour(ts) < 12 GROUP BY ALL")
def trend_points_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    snaps = e.select(F.col("event_type").alias("entity"), F.lit("event").alias("entity_type"), F.col("ts").alias("timestamp"), F.create_map(F.lit("value"), F.coalesce("value", F.lit(0.0))).alias("metrics"), F.when(F.hour("ts") < 12, "main").otherwise("other").alias("workspace"))
    got = history.metric_points(snaps, 2, "main", F.lit(last))
    return got.groupBy("entity", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("points"))


@query("snapshots_kept", "SELECT event_type AS entity, count(DISTINCT date_trunc('second', ts)) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1")
def snapshots_kept(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots are saved as JSON lines, thinned to one per entity and second and cut to a month by a rewrite of the folder."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    snaps = e.select(F.col("event_type").alias("entity"), F.lit("event").alias("entity_type"), F.col("ts").cast("timestamp").alias("timestamp"), F.create_map(F.lit("value"), F.coalesce("value", F.lit(0.0))).alias("metrics"), F.lit("main").alias("workspace"))
    path = f"{shared_folder(spark)}/quarry-snapshots/{uuid.uuid4().hex}"
    reports.save_snapshots(snaps, path)
    kept = reports.prune_snapshots(spark, path, 1, F.lit(last).cast("timestamp"))
    return history.dedupe_snapshots(kept).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("find_exact_of_type", f"WITH {G.ENT} SELECT entity_name AS entity, source_id, CAST(CASE WHEN lower(entity_name) = 'loader' THEN 1.0 ELSE 0.9 END AS DOUBLE) AS score FROM e WHERE contains(lower(entity_name), 'loader') AND lower(entity_type) = 'class'")
def find_exact_of_type(spark: SparkSession, d: str) -> DataFrame:
    return search.find_exact(G.entities(spark, d), "LOADER", "Class").select("entity", "source_id", "score")


@query("find_exact_top", f"WITH {G.ENT} SELECT entity_name AS entity, CAST(0.9 AS DOUBLE) AS score FROM e WHERE contains(lower(entity_name), 'mapper') ORDER BY entity_name LIMIT 20")
def find_exact_top(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty of a name that many contain: none of the fuzzy matches gets among them."""
    return search.find(G.entities(spark, d), "mapper").select("entity", "score")


_METHOD = "(SELECT min(entity_name) FROM be WHERE entity_type = 'method')"


@query("similar_exact", f"WITH {G.SIDES}, q AS (SELECT {_METHOD} AS name), s AS (SELECT 'base' AS workspace, entity_name FROM be UNION ALL SELECT 'head', entity_name FROM he), t AS (SELECT 'base' AS workspace, src_id, tgt_id FROM br UNION ALL SELECT 'head', src_id, tgt_id FROM hr) SELECT workspace, entity_name AS entity, (SELECT count(*) FROM t WHERE t.workspace = s.workspace AND (src_id = entity_name OR tgt_id = entity_name)) AS relations FROM s WHERE entity_name = (SELECT name FROM q)")
def similar_exact(spark: SparkSession, d: str) -> DataFrame:
    base, head = G.snapshot(spark, d, "min"), G.snapshot(spark, d, "max")
    name = base[0].where("entity_type = 'method'").agg(F.min("entity_name")).first()[0] or "main"
    return search.similar({"base": base, "head": head}, name).where("match_type = 'exact'").select("workspace", "entity", "relations")


@query(
    "graph_query_class",
    f"""WITH {G.GRAPH}, cls AS (SELECT min(entity_name) AS name FROM e WHERE entity_type = 'class' AND entity_name IN (SELECT regexp_replace(src_id, '\\.[^.]*$', '') FROM r WHERE coalesce(resolution_qualifier, 'resolved') = 'resolved')),
 seeds AS (SELECT name AS s, 0 AS own FROM cls UNION ALL SELECT entity_name, 1 FROM e, cls WHERE starts_with(entity_name, name || '.') OR starts_with(entity_name, name || '::')),
 hit AS (SELECT own, tgt_id AS node, min(coalesce(keywords, '')) AS relation FROM r JOIN seeds ON src_id = s WHERE coalesce(resolution_qualifier, 'resolved') = 'resolved' AND tgt_id <> '' AND tgt_id <> src_id GROUP BY ALL)
 SELECT node AS entity, arg_min(relation, own) AS relation FROM hit GROUP BY node""",
)
def graph_query_class(spark: SparkSession, d: str) -> DataFrame:
    e, r = _er(spark, d)
    methods = traverse.trusted_edges(r).select(F.regexp_replace("src", r"\.[^.]*$", "").alias("entity_name")).distinct()
    name = e.where("entity_type = 'class'").join(methods, "entity_name", "left_semi").agg(F.min("entity_name")).first()[0] or "none"
    return traverse.graph_query(r, e, name, "callees").select("entity", "relation")


@query("resolve_short_name", f"WITH {G.ENT}, l AS (SELECT regexp_replace(entity_name, '^.*\\.', '') AS short, count(*) AS n, min(entity_name) AS name FROM e WHERE contains(entity_name, '.') AND NOT contains(entity_name, '::') GROUP BY 1) SELECT min(name) AS name FROM l WHERE n = 1 AND short NOT IN (SELECT entity_name FROM e) AND short NOT IN (SELECT regexp_replace(entity_name, '^.*(\\.|::)', '') FROM e WHERE contains(entity_name, '::'))")
def resolve_short_name(spark: SparkSession, d: str) -> DataFrame:
    e = G.entities(spark, d)
    short = F.regexp_replace("entity_name", r"^.*\.", "")
    one = e.where("contains(entity_name, '.') AND NOT contains(entity_name, '::')").groupBy(short.alias("short")).agg(F.count(F.lit(1)).alias("n"), F.min("entity_name").alias("name")).where("n = 1")
    other = e.where("contains(entity_name, '::')").select(F.regexp_replace("entity_name", r"^.*(\.|::)", "").alias("short"))
    one = one.join(e.select(F.col("entity_name").alias("short")), "short", "left_anti").join(other, "short", "left_anti")
    asked = one.agg(F.min_by("short", "name")).first()[0] or "none"
    return spark.createDataFrame([(traverse.resolve_name(e, asked),)], "name string")


# vectors

_U = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"


@query("knn_batch", "SELECT q.vec_id AS query, v.vec_id AS other, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance FROM embeddings q JOIN embeddings v ON len(q.embedding) = len(v.embedding) WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), v.vec_id) <= 10")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return search.knn_many(v, v.where("vec_id % 100 = 0")).withColumn("distance", F.round("distance", 6))


_FINE = "len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)"


@query("search_of_type", f"WITH {G.ENT}, v AS (SELECT entity_name, source_id, list_distance({_U}, (SELECT {_U} FROM embeddings WHERE vec_id = 0)) AS x FROM vec_node_descriptions WHERE {_FINE} AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY vec_id DESC) = 1) SELECT v.entity_name AS entity, coalesce(entity_type, '') AS type, v.source_id, substr(coalesce(description, ''), 1, 200) AS description, round_even(greatest(0, 1 - x * x / 2), 3) AS score FROM v JOIN e USING (entity_name) WHERE lower(entity_type) = 'method' ORDER BY x, v.entity_name LIMIT 20")
def search_of_type(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vec_node_descriptions")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = v.where((F.size("embedding") == 64) & fine).groupBy("entity_name").agg(F.max(F.struct("vec_id", "embedding", "source_id")).alias("r"))
    rows = rows.select("entity_name", search.normalised(F.col("r.embedding")).alias("embedding"), "r.source_id")
    q = table(spark, d, "embeddings").where("vec_id = 0").select(search.normalised(F.col("embedding")).alias("u")).first()
    return search.search(rows, G.entities(spark, d), list(q.u) if q else [1.0], "Method")
