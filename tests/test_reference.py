"""The engine's own operators on small cases."""

import json
import random
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarrygraph import api
from quarrygraph.functions import exprs as X
from quarrygraph.functions.names import matching_ratio, ratio_bound
from quarrygraph.operators.ranks import ranked
from quarrygraph.operators import debt, diffs, graph, history, impact, modules, search, store, traverse
from quarrygraph.sources import foreign, ndjson, reports, textlogs
from quarrygraph.streaming.ingest import ingest_stream, windowed_counts


def ents(spark, data):
    return spark.createDataFrame([(n, t, s, None) for n, t, s in data], "entity_name string, entity_type string, source_id string, description string").withColumn("degree", F.lit(1)).withColumn("src", F.lit("clash"))


def rels(spark, data):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in data], "src_id string, tgt_id string, keywords string, resolution_qualifier string").withColumn("source_id", F.lit("src/a.py:3")).withColumn("n", F.lit(1)).withColumn("node", F.lit("clash"))


def values(spark, expr, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_paths(spark):
    assert values(spark, lambda v: X.module_of(v, 2), ["src/a/b/c.py:1", "src/c.py", "c.py", "", None, "a//b/./c.py", "/r/x/y.py"]) == ["src/a", "src", ".", ".", ".", "a/b", "//r"]
    assert values(spark, X.without_lines, ["a.py:1-5", "a.py", "a:b", "a.py:-1", ":1"]) == ["a.py", "a.py", "a:b", "a.py", ":1"]
    assert values(spark, X.without_line_range, ["a.py:1-5", "a.py:7", "a.py:x"]) == ["a.py", "a.py", "a.py:x"]
    assert values(spark, lambda v: X.file_and_line(v)[0], ["a.py:3-9", "a.py", "a:b", None]) == ["a.py", "a.py", "a:b", ""]
    assert values(spark, lambda v: X.file_and_line(v)[1], ["a.py:3-9", "a.py", "a:b", None]) == [3, 0, 0, 0]
    assert values(spark, X.python_module, ["a/b.py", "./a.py", "x.ts"]) == ["a.b", "a", ""]
    assert values(spark, lambda v: X.store_module(v, 2, "src/"), ["src/a/b/c.py", "q/w/e", None]) == ["a/b", "q/w", ""]


def test_predicates(spark):
    assert values(spark, X.is_noise, ["len", "x.get", "get", "x.getter", "json.dumps"]) == [True, True, False, False, True]
    assert values(spark, X.is_test_source, ["a/tests/b.py", "test_x.py:1", "x_test.py", "a.spec.ts", None, "src/a.py"]) == [True, True, True, True, False, False]
    assert values(spark, X.is_test_file, ["tests/a.py", "src/test_a.py", "a/test/b", "src/a.py", None]) == [True, True, True, False, False]
    assert values(spark, X.is_core_module, ["src/auth/x.py", "core.py", "a/score.py", "db/x", None]) == [True, True, False, True, False]
    assert values(spark, X.is_bug_fix, ["fix: a", "Fix it", "prefix: a", "will fix that bug", None]) == [True, True, False, True, False]
    assert values(spark, X.is_generated_file, ["README_AI.md", "a/b/README_AI.md", "a/__pycache__/x", "x/y.pyc", "README.md", "CHANGELOG.md"]) == [True, True, True, True, False, True]
    assert values(spark, lambda v: X.may_be_unlinked(v, F.lit("src/a.py")), ["AppConfig", "AppConfig.run", "A::__len__", "a.to_dict", "a.run", "ConfigX"]) == [True, True, True, True, False, False]
    assert values(spark, X.is_intricate, ["MyParser.visit_x", "a.main", "a.mainly", "x.render_it"]) == [True, True, False, True]


def toy(spark):
    e = ents(spark, [("a", "function", "src/x/a.py:1-2"), ("b", "class", "src/x/b.py:1"), ("b.__init__", "method", "src/x/b.py:2"), ("c", "function", "src/y/c.py:1"), ("d", "function", None), ("f", "file", "src/y/f.py"), ("len", "function", "src/y/c.py"), ("ext", "external", "external"), (None, "x", "y"), ("", "x", "y"), ("m.__init__", "method", "src/z/m.py")])
    r = rels(spark, [("a", "b.__init__", "CALLS"), ("a", "c", "CALLS"), ("a", "c", "IMPORTS"), ("c", "c", "CALLS"), ("d", "gone", "CALLS"), ("x", "y", "CALLS"), (None, "a", "CALLS"), ("a", "", "CALLS"), ("a", "ext", "CALLS")])
    return e, r


def test_degrees_and_orphans(spark, rows):
    e, r = toy(spark)
    assert [(x[0], x[3]) for x in rows(graph.degrees(r, e, "in", 2))] == [("c", 3)]
    assert [(x[0], x[3]) for x in rows(graph.degrees(r, e, "out", 1, "src/x/"))] == [("a", 4)]
    assert {(x[0], x[3]) for x in rows(graph.orphans(r, e, ["file"]))} == {("b", False), ("d", True), ("len", False), ("m.__init__", False)}


def test_topology(spark, rows):
    e, r = toy(spark)
    t = graph.Topology(r, e, hub=3, god=3)
    assert {(x[0], x[3]) for x in rows(t.orphans())} == {("d", "neighbors_unresolved")}
    assert [(x[0], x[3]) for x in rows(t.hubs())] == [("c", 3)] and [(x[0], x[3]) for x in rows(t.gods())] == [("a", 3)]
    assert rows(t.placeholders()) == [("src/z", 1)]
    assert rows(t.samples("tgt", t.hubs(), 2)) == [("c", "a, a")]
    assert [tuple(x)[:2] for x in t.coupling().collect()] == [(2, 2)]
    s = t.score().first()
    assert (s.entities, s.orphans, s.placeholders, s.density) == (7, 1, 1, 0.5) and s.score == 100 - 15 - 5 - 5
    empty = graph.Topology(r.limit(0), e.limit(0))
    assert empty.score().first().score == 100 and empty.resolution().first().ratio is None
    scoped = graph.Topology(r, e, 1, 1, module="src/x")
    assert {x[0] for x in rows(scoped.gods())} == {"a"} and {x[0] for x in rows(scoped.hubs())} == {"b.__init__"}
    st = graph.store_topology(r, e, 3, 3)
    assert {x[0] for x in rows(st["orphans"])} == {"d", "b"} or {x[0] for x in rows(st["orphans"])} == {"b"}
    assert graph.common_prefix(ents(spark, [("a", "", "src/core/a.py:1"), ("b", "", "src/cli/b.py")])) == "src/"
    assert graph.common_prefix(e.limit(0)) == ""


def test_no_nested_loops(spark):
    e, r = toy(spark)
    for df in (graph.orphans(r, e), graph.resolvable(graph.edges_of(r), e), graph.Topology(r, e).orphans(), store.delete_names(e, r, e)[1]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_modules(spark, rows):
    e, r = toy(spark)
    assert rows(modules.dependencies(r, e, 2, auto=False)) == [("src/x", "src/y", "CALLS", 1), ("src/x", "src/y", "IMPORTS", 1)]
    deep = ents(spark, [("a", "f", "src/p/q/x/a.py"), ("b", "f", "src/p/q/y/b.py"), ("c", "f", "top.py")])
    assert modules.auto_depth(deep, 1) == 4 and modules.auto_depth(deep.limit(0), 2) == 2
    assert rows(modules.dependencies(rels(spark, [("a", "b", "K")]), deep, 1)) == [("src/p/q/x", "src/p/q/y", "K", 1)]
    top = {(x.module, x.rank): (x.entity, x.n) for x in modules.overview_top(r, e).collect()}
    assert top[("src/x", 1)] == ("a", 6) and top[("src/y", 1)] == ("c", 4)
    assert ("src/x", "b.py") in rows(modules.overview_files(e)) and ("src/x", "class", 1) in rows(modules.overview_counts(e))
    fresh = modules.freshness(e, spark.createDataFrame([("src/x/a.py",)], "file string"))
    s = modules.freshness_summary(fresh).first()
    assert (s.valid, s.total) == (1, 7) or s.valid == 1
    assert modules.freshness_summary(fresh.limit(0)).first().ratio == 1.0
    langs = modules.languages(spark.createDataFrame([(f"a{i}.go",) for i in range(12)] + [("b.py",), ("vendor/x.go",), ("n",)], "file string"))
    assert modules.uncovered_language(langs, ["python"]) == "go" and modules.uncovered_language(langs, ["go"]) is None


def brute_bfs(edges, seed, depth):
    seen, out, front = {seed}, {}, {seed}
    for d in range(1, depth + 1):
        new = {}
        for s, t, k in edges:
            if s in front and t not in seen:
                new[t] = min(new.get(t, k), k)
        out |= {n: (k, d) for n, k in new.items()}
        seen |= set(new)
        front = set(new)
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_bfs(spark, depth):
    r = random.Random(depth)
    edges = [(f"n{r.randrange(20)}", f"n{r.randrange(20)}", r.choice("KLM")) for _ in range(45)]
    df = spark.createDataFrame(edges, "src string, tgt string, kind string")
    seeds = spark.createDataFrame([("n0",), ("n1",), ("none",), ("n0",)], "seed string")
    got = traverse.bfs(df, seeds, depth).collect()
    for s in ("n0", "n1", "none"):
        assert {x.node: (x.relation, x.depth) for x in got if x.seed == s} == brute_bfs(edges, s, depth)
        back = [(b, a, k) for a, b, k in edges]
        if s == "n0":
            assert {x.node: (x.relation, x.depth) for x in traverse.bfs(df, seeds, depth, "in").collect() if x.seed == s} == brute_bfs(back, s, depth)
    assert traverse.bfs(df, seeds.limit(0), 2).count() == 0


def test_graph_query(spark, rows):
    e = ents(spark, [("p.C", "class", "s1"), ("p.C.run", "method", "s2"), ("p.C::stop", "method", "s3"), ("q.f", "function", "s4"), ("u.f", "function", "s5")])
    r = rels(spark, [("p.C.run", "q.f", "CALLS"), ("p.C::stop", "u.f", "CALLS", "resolved"), ("p.C.run", "phantom", "CALLS", "unresolved"), ("p.C", "q.f", "REFERENCES"), ("u.f", "p.C", "IMPORTS", "ambiguous")])
    got = rows(traverse.graph_query(r, e, "C"))
    assert got == [("callees", "q.f", "REFERENCES", "s4"), ("callees", "u.f", "CALLS", "s5")]
    assert ("callers", "u.f", "IMPORTS", "s5") in rows(traverse.graph_query(r, e, "C", include_unresolved=True))
    assert rows(traverse.graph_query(r, e, "q.f", "callers", "CALLS", 2)) == [("callers", "p.C.run", "CALLS", "s2")]
    assert traverse.resolve_name(e, "f") == "f" and traverse.resolve_name(e, "stop") == "p.C::stop"
    assert {x[2] for x in rows(traverse.attach_relations(spark.createDataFrame([("q.f",)], "entity string"), r))} == {"p.C.run", "p.C"}


def test_branch_diff(spark, rows):
    base = ents(spark, [("a", "f", "src/m/a.py"), ("b", "f", "src/m/b.py"), ("c", "f", "src/n/c.py")])
    head = ents(spark, [("a", "f", "src/m/a.py"), ("c", "f", "src/n/c.py"), ("d", "f", "src/n/d.py")])
    br, hr = rels(spark, [("a", "b", "CALLS"), ("a", "zz", "CALLS"), ("b", "c", "CALLS")]), rels(spark, [("a", "d", "CALLS"), ("d", "c", "CALLS"), ("a", "d", "CALLS")])
    b = diffs.BranchDiff(base, br, head, hr)
    assert rows(b.broken_chains()) == [("a", "b", "CALLS")] and rows(b.new_chains()) == [("a", "d", "CALLS")]
    assert tuple(b.summary().first()) == (1, 1, 2, 2, 2, 1, 1, 2, 1, 0)
    assert rows(b.top_modules()) == [("src/m", 1, 2), ("src/n", 1, 0)]
    assert rows(b.content(None)) == [("a", "unknown"), ("c", "unknown")] and b.content_status(b.content(None)).first().status == "unavailable"
    assert b.content_status(b.content(F.col("source_id"))).first().status == "available"
    c = diffs.compare(base, br, head, hr)
    assert tuple(c["summary"].first()) == (1, 1, 2, 2)
    same = diffs.BranchDiff(base, br, base, br)
    assert same.edges().count() == 0 and same.summary().first().modules_changed == 0


def test_workspace(spark, rows, tmp_path):
    w = store.Workspace(spark, str(tmp_path), "repo:feature/x")
    assert w.table("entities").count() == 0 and w.get_meta("k") is None
    e = spark.createDataFrame([("a", "f", "x.py:1", "h1"), ("b", "f", "x.py:2", "h2"), ("c", "f", "y.py:1", None), (None, "f", "q", None)], "entity_name string, entity_type string, source_id string, content_hash string")
    r = spark.createDataFrame([("a", "b", "CALLS", 1, "x.py:1"), ("a", "b", "CALLS", 2, "x.py:9"), ("b", "c", None, 3, "x.py:2"), ("", "c", "CALLS", 4, "z")], "src_id string, tgt_id string, keywords string, ord bigint, source_id string")
    out = w.ingest(e, r)
    assert out["resolved_ratio"] == 0.75 and w.get_meta("resolved_ratio") == "0.75"
    assert rows(w.table("relations").select("src_id", "tgt_id", "keywords", "ord")) == [("a", "b", "CALLS", 2), ("b", "c", "", 3)]
    new = spark.createDataFrame([("a", "f", "x.py:1", "h1"), ("b", "F2", "x.py:2", "changed"), ("n", "f", "x.py:5", None)], e.schema)
    assert w.ingest_changes(new.where("entity_name <> 'a'"), r.limit(0), spark.createDataFrame([("x.py",)], "file string")) .items() >= {"skip": 0, "upsert": 2, "delete": 1}.items()
    assert rows(w.table("entities").select("entity_name", "entity_type")) == [("b", "F2"), ("c", "f"), ("n", "f")]
    assert rows(w.table("relations").select("src_id", "tgt_id")) == [("b", "c")]
    assert w.write_embeddings(spark.createDataFrame([("b", "s", [1.0, 2.0]), ("c", "s", [1.0]), ("n", "s", None)], "entity_name string, source_id string, embedding array<float>"), 2) == 1
    with pytest.raises(ValueError):
        w.check_dims(3)
    w.delete_sources(spark.createDataFrame([("x.py:2",)], "source_id string"))
    assert rows(w.table("entities").select("entity_name")) == [("c",), ("n",)] and w.table("relations").count() == 0
    w.clear()
    # the last export had no relations, so its ratio is unknown; clearing keeps the metadata
    assert w.table("entities").count() == 0 and w.get_meta("resolved_ratio") == ""
    assert w.refresh("auto", e, r, fingerprint="1/2/3")["mode"] == "rebuild" and w.refresh("auto", e, r, fingerprint="1/2/3") == {"mode": "noop"}
    store.Workspace(spark, str(tmp_path), "repo:main").write(e, r)
    assert store.Workspace.first_filled(spark, str(tmp_path), "repo", "nowhere").name == "repo:main"
    q = api.Quarry(spark, str(tmp_path))
    assert q.list() == ["repo:feature-x", "repo:main"]
    with pytest.raises(ValueError):
        q.drop("repo:main")
    q.drop("repo:main", confirm=True)
    assert q.list() == ["repo:feature-x"]


def test_provisioning():
    made = {"provisioned_by": "branch-diff", "provisioned_ref": "A", "provisioned_sha": "1"}
    assert [store.provisioning(*a) for a in (({}, 0, "A", "1"), (made, 5, "A", "1"), (made, 5, "A", "2"), ({}, 5, "A", "1"))] == ["create", "reuse", "rebuild", "refuse"]


def test_incremental_actions(spark, rows):
    s = "entity_name string, source_id string, content_hash string"
    old = spark.createDataFrame([("same", "a.py:1", "h"), ("diff", "a.py:2", "h"), ("gone", "a.py:3", "h"), ("nohash", "a.py:4", None), ("pyi", "a.pyi:1", "h"), ("moved", "a.py:9", "h")], s)
    new = spark.createDataFrame([("same", "a.py:5", "h"), ("diff", "a.py:2", "H"), ("new", "a.py:3", "h"), ("nohash", "a.py:4", None), ("moved", "b.py:9", "h")], s)
    files = spark.createDataFrame([("a.py",), ("b.py",), ("a.py",)], "file string")
    assert rows(store.incremental_actions(old, new, files)) == [("diff", "upsert"), ("gone", "delete"), ("moved", "upsert"), ("new", "upsert"), ("nohash", "upsert"), ("same", "skip")]


NDJSON = [
    {"type": "meta", "schema_version": 2, "generator": "x"},
    {"type": "entity", "id": "p.a", "entity_type": "function", "source_id": "src/tests/a.py:3", "signature": "a()", "description": "does", "provenance": "ast", "content_hash": "h"},
    {"type": "entity", "id": "p.b", "entity_type": "odd", "source_id": "src/b.py:3", "description": "", "provenance": "ast"},
    {"type": "entity", "id": "p.c", "source_id": "x"},
    {"type": "edge", "kind": "CALLS", "src": "p.a", "dst": "p.b", "resolution_qualifier": "resolved", "source_id": "s"},
    {"type": "edge", "kind": "CALLS", "src": "p.a", "dst_raw": "x.y", "candidates": ["q", "w"], "resolution_qualifier": "ambiguous", "source_id": "s"},
    {"type": "edge", "kind": "ODD", "src": "p.a", "dst_raw": "z", "resolution_qualifier": "unresolved", "source_id": "s"},
    {"type": "edge", "kind": "CALLS", "src": "p.a", "resolution_qualifier": "unresolved", "source_id": "s"},
    {"type": "edge", "kind": "CALLS", "src": "p.a", "dst": None, "resolution_qualifier": "resolved", "source_id": "s"},
    {"type": "edge", "kind": "CALLS", "src": "p.a", "dst": "p.b", "resolution_qualifier": "maybe", "source_id": "s"},
    {"type": "what"},
]


def test_ndjson(spark, rows, tmp_path):
    p = tmp_path / "g.ndjson"
    p.write_text("\n".join(map(json.dumps, NDJSON)) + "\n\n{broken\n  \n")
    rec = ndjson.read(spark, str(p)).cache()
    assert rows(ndjson.entities(rec).select("entity_name", "description", "file_path", "content_hash")) == [("p.a", "a() | does", "src/tests/a.py", "h"), ("p.b", "", "src/b.py", None)]
    assert rows(ndjson.relations(rec).select("tgt_id", "weight", "candidates")) == [("p.b", 1.0, None), ("x.y", 0.5, ["q", "w"]), ("z", 0.5, None)]
    got = {(r.verdict, r.type): r.n for r in ndjson.verdicts(rec).collect()}
    assert got == {("stored", "meta"): 1, ("stored", "entity"): 2, ("skipped", "entity"): 1, ("stored", "edge"): 3, ("dropped", "edge"): 1, ("skipped", "edge"): 2, ("skipped", "what"): 1, ("skipped", ""): 1}
    warned = {r.warning for r in ndjson.warnings(rec).collect()}
    assert {"bad JSON", "unknown record type", "unknown entity_type", "unknown edge kind", "unknown resolution_qualifier", "entity: missing required field", "schema_version is newer than supported", "meta: missing provenance_completeness"} <= warned
    assert "no meta record" in {r.warning for r in ndjson.warnings(rec.where("type = 'edge'")).collect()} and ndjson.is_safe(rec) and not ndjson.is_safe(rec.limit(0))
    assert ndjson.raw_records(spark, str(p)).count() == len(NDJSON)
    q = api.Quarry(spark, str(tmp_path / "ws"))
    assert ("entity_test", "true", 1) in rows(q.import_ndjson(str(p), dry_run=True)) and q.list() == []
    q.import_ndjson(str(p))
    assert q.list() == ["g:imported"] and q.tables("g:imported")[1].count() == 3


def test_foreign(spark, rows):
    nodes = spark.createDataFrame([("1", "class", "A", "a.ts", 1, 2, "doc", "sig", 5), ("2", "class", "A", "b.ts", None, 2, None, None, 9), ("3", "import", "lib", "a.ts", 1, 1, None, None, 1), ("4", "file", "f", "f.ts", 1, 1, None, None, 1)], "id string, kind string, qualified_name string, file_path string, start_line int, end_line int, docstring string, signature string, updated_at bigint")
    edges = spark.createDataFrame([("1", "2", "extends", 3, "p"), ("1", "3", "imports", None, None), ("1", "99", "calls", 1, None), ("3", "1", "calls", 1, None), ("1", "2", "contains", 1, None)], "source string, target string, kind string, line int, provenance string")
    assert [r[0] for r in rows(foreign.entities(nodes))] == ["a.ts::A", "b.ts::A", "f"]
    assert rows(foreign.relations(nodes, edges).select("src_id", "tgt_id", "keywords", "source_id", "resolution_qualifier")) == [("a.ts::A", "<unresolved>", "CALLS", "a.ts::A:1", "unresolved"), ("a.ts::A", "b.ts::A", "INHERITS", "a.ts::A:3", "resolved"), ("a.ts::A", "lib", "IMPORTS", "a.ts::A:0", "unresolved")]
    assert foreign.fingerprint(nodes, edges).first()[0] == "4/5/9"
    meta = lambda v: spark.createDataFrame([("extraction_version", v)], "key string, value string")
    tabs = {"nodes": nodes, "edges": edges, "files": nodes, "unresolved_refs": nodes, "project_metadata": meta("24")}
    foreign.check(tabs)
    for bad in (tabs | {"project_metadata": meta("25")}, tabs | {"edges": edges.drop("line")}, {k: v for k, v in tabs.items() if k != "files"}):
        with pytest.raises(ValueError):
            foreign.check(bad)


LOG = "noise\nabc1|al|100|fix: a|b\n1\t2\tsrc/a.py\n-\t-\tbin.png\nnonsense\n\nabc2|Bo|200|feat\n3\t0\tsrc/a|b.py\nzz|x\nabc3|al |300|empty\n"


def test_gitlog_and_history(spark, rows, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    c = textlogs.commits(textlogs.lines(spark, str(tmp_path / "log.txt")))
    got = {r.sha: r for r in c.collect()}
    assert got["abc1"].message == "fix: a|b" and [tuple(f) for f in got["abc1"].files] == [("src/a.py", 1, 2), ("bin.png", 0, 0)]
    assert [f.path for f in got["abc2"].files] == ["src/a|b.py"] and got["abc3"].files == []
    m = history.file_metrics(c, F.lit(100 + 86400 * 3))
    by = {r.file: r for r in m.collect()}
    assert (by["src/a.py"].bug_fixes, by["src/a.py"].churn, by["src/a.py"].modified_days) == (1, 3, 3)
    assert {r.risk for r in history.bus_factor(m, c).collect()} == {"critical"}
    one = c.where("author <> 'Bo'")
    assert {r.risk for r in history.bus_factor(history.file_metrics(one), one).collect()} == {"informational"}
    assert history.file_metrics(c.limit(0)).count() == 0


def test_hotspots_and_ties(spark, rows):
    f = "file string, commits bigint, churn bigint, authors bigint"
    m = spark.createDataFrame([("a", 10, 999, 1), ("b", 10, 999, 2), ("c", 1, 9, 1), ("CHANGELOG.md", 99, 9999, 1), ("d", 3, 0, 1), ("e", 2, 99, 9)], f)
    assert rows(history.hotspots(m)) == [(1, "a", 10, 499, 100), (2, "b", 10, 499, 100), (3, "e", 2, 100, 40)]
    c = spark.createDataFrame([("1", a, 1, "m", [("f", 1, 1)]) for a in "bab"] + [("2", None, 1, None, [("g", None, None), (None, 1, 1)])], "sha string, author string, ts bigint, message string, files array<struct<path: string, added: bigint, deleted: bigint>>")
    by = {r.file: r for r in history.file_metrics(c).collect()}
    assert by["f"].primary_author == "b" and by["g"].primary_author == "unknown" and by["g"].churn == 0
    order = [r.file for r in history.by_risk(spark.createDataFrame([("x", "high", 5), ("y", "critical", 1), ("z", "critical", 9)], "file string, risk string, commits int")).collect()]
    assert order == ["z", "y", "x"]


def test_trends(spark):
    day = lambda d: datetime(2025, 1, 1 + d, 12)
    rows_ = [("up", "f", day(d), {"c": 2.0 * d + 1, "flat": 5.0}, "w") for d in range(5)] + [("few", "f", day(0), {"c": 1.0}, "w")] + [("oneday", "f", datetime(2025, 1, 1, h), {"c": float(h)}, "w") for h in (1, 2, 3)] + [("none", "f", day(1), None, "w")]
    s = spark.createDataFrame(rows_, "entity string, entity_type string, timestamp timestamp, metrics map<string,double>, workspace string")
    t = {(r.entity, r.metric): r for r in history.trends(history.metric_points(s, None)).collect()}
    assert set(t) == {("up", "c"), ("up", "flat"), ("oneday", "c")}
    up, flat, one = t[("up", "c")], t[("up", "flat")], t[("oneday", "c")]
    assert (round(up.slope, 9), round(up.intercept, 9), round(up.r2, 9), up.direction, up.alert) == (2, 1, 1, "increasing", True) and up.forecast == pytest.approx(2 * 34 + 1)
    assert (flat.slope, flat.r2, flat.direction) == (0, 0, "stable") and (one.slope, one.intercept, one.r2) == (0, 2, 0)
    dup = s.union(s.where("entity = 'few'"))
    assert history.dedupe_snapshots(dup).where("entity = 'few'").count() == 1
    assert history.recent(s, 12, F.lit("2026-01-05 00:00:00").cast("timestamp")).count() < s.count()
    assert history.metric_points(s, 6, "other").count() == 0


DIFF = """diff --git a/src/m.py b/src/m.py
@@ -10,2 +10,3 @@ def f
+x
@@ -40 +42,0 @@
diff --git a/n.py b/n.py
new file mode 100644
@@ -0,0 +1,5 @@
diff --git a/o.py b/o.py
deleted file mode 100644
@@ -1,5 +0,0 @@
"""


def test_diff_and_impact(spark, rows):
    files = textlogs.changed_files(textlogs.numbered(spark.createDataFrame([("d", DIFF)], "file string, value string")))
    got = {r.path: (r.change_type, [tuple(x) for x in r.added], [tuple(x) for x in r.deleted]) for r in files.collect()}
    assert got == {"src/m.py": ("MODIFIED", [(10, 12)], [(10, 11), (40, 40)]), "n.py": ("ADDED", [(1, 5)], []), "o.py": ("DELETED", [], [(1, 5)])}
    symbols = spark.createDataFrame([("src/m.py", "f", 5, 11), ("src/m.py", "g", 12, 39), ("src/m.py", "h", 60, 70), ("n.py", "k", 1, 5), ("z.py", "z", 1, 99)], "file string, name string, line_start int, line_end int")
    changed = impact.qualified(impact.changed_symbols(files, symbols))
    assert rows(changed.select("symbol", "change", "lines_changed")) == [("n.k", "ADDED", 5), ("o.<deleted:o>", "DELETED", 0), ("src.m.f", "MODIFIED", 4), ("src.m.g", "MODIFIED", 1)]
    r = spark.createDataFrame([("t.one", "src.m.f", "CALLS", "tests/t.py:3-4"), ("u", "t.one", "CALLS", "u.py:9"), ("v", "u", "CALLS", "v.py"), ("w", "src.m.f", "IMPORTS", "w.py")], "src_id string, tgt_id string, keywords string, source_id string")
    found = impact.callers(r, changed, 5)
    assert rows(found) == [("t.one", "tests/t.py", 3, 1), ("u", "u.py", 9, 2)]
    assert impact.callers(r, changed, 5, full=True).count() == 3 and impact.callers(r, changed, 1).count() == 1
    assert rows(impact.affected_tests(found)) == [("tests/t.py",)] and ("tests.t",) in rows(impact.affected_modules(changed, found))
    assert impact.risk(changed, found).first().level == "high"
    few = changed.limit(0)
    level = lambda ratio: impact.risk(few, found.limit(0), ratio).first().level
    assert [level(x) for x in (None, 0.05, 0.3, 0.9)] == ["low", "unknown", "medium", "low"]


def _export(spark, tmp_path, *records):
    path = tmp_path / "export.ndjson"
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n")
    return ndjson.read(spark, str(path))


def _node(name, kind, line="a.py:1", **more):
    return {"type": "entity", "id": name, "entity_type": kind, "source_id": line, "provenance": "ast", "description": f"about {name}", **more}


def _edge(src, dst, kind="CALLS", line="a.py:2"):
    return {"type": "edge", "kind": kind, "src": src, "dst": dst, "resolution_qualifier": "resolved", "source_id": line}


def test_the_later_line_wins(spark, rows, tmp_path):
    rec = _export(spark, tmp_path, _node("a.b", "method"), _node("a.c", "method"), {"type": "meta", "schema_version": 1, "generator": "z"}, _node("a.b", "class"), {"type": "meta", "schema_version": 1, "generator": "a"}, _edge("a.b", "a.c", line="z.py:1"), _edge("a.b", "a.c", line="b.py:1"))
    w = store.Workspace(spark, str(tmp_path / "ws"), "x")
    w.ingest(ndjson.entities(rec), ndjson.relations(rec))
    assert rows(w.table("entities").select("entity_name", "entity_type")) == [("a.b", "class"), ("a.c", "method")]
    assert rows(w.table("relations").select("source_id")) == [("b.py:1",)]
    assert ndjson.meta(rec).first().generator == "a" and ndjson.meta(rec.where("type <> 'meta'")).count() == 0
    assert tuple(ndjson.test_ratios(rec).first()) == (3, 2, 0.0, 0.0)


def test_one_embedding_per_text_one_version_per_ingest(spark, rows, tmp_path):
    rec = _export(spark, tmp_path, *[_node(f"n{i}", "function") for i in range(40)], _edge("n1", "n2"), _edge("n1", "gone"))
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[1.0, float(len(t))] for t in texts]

    w = store.Workspace(spark, str(tmp_path / "ws"), "x")
    out = w.ingest(ndjson.entities(rec), ndjson.relations(rec), embed=lambda e: search.embed_entities(e, embed), dims=2, embedding_provider="p")
    assert calls.value == 40 == out["embedded"] == w.vector_count() and out["resolved_ratio"] == 0.5
    assert {v.split("/")[1] for v in w.versions().values()} and len({v.split("/")[1] for v in w.versions().values()}) == 1
    reader = w.table("entities")
    files = spark.createDataFrame([("a.py",)], "file string")
    again = w.ingest_changes(ndjson.entities(rec).where("entity_name <> 'n2'"), ndjson.relations(rec), files, embed=lambda e: search.embed_entities(e, embed), dims=2)
    assert again["delete"] == 1 and again["resolved_ratio"] == 0.0 and w.get_meta("resolved_ratio") == "0.0" and w.get_meta("embedding_provider") == "p"
    assert reader.count() == 40 and w.table("entities").count() == 39 == w.vector_count()
    w.keep_seconds = 0
    w.write(ndjson.entities(rec).limit(1))
    assert len(list((tmp_path / "ws" / "x" / "entities").iterdir())) == 1


def test_embedding_that_fails(spark, tmp_path):
    rec = _export(spark, tmp_path, _node("n", "function"))
    w = store.Workspace(spark, str(tmp_path / "ws"), "x")

    def broken(error):
        def embed(texts):
            raise error

        return lambda e: search.embed_entities(e, embed)

    with pytest.warns(UserWarning, match="embedding failed"):
        assert w.ingest(ndjson.entities(rec), ndjson.relations(rec), embed=broken(OSError("no server")), dims=2)["embedded"] == 0
    with pytest.raises(Exception, match="wrong key"):
        w.ingest(ndjson.entities(rec), ndjson.relations(rec), embed=broken(ValueError("wrong key")), dims=2)
    assert w.table("entities").count() == 1 and w.vector_count() == 0
    w.write_embeddings(spark.createDataFrame([("n", "a.py", [1.0, 2.0])], "entity_name string, source_id string, embedding array<float>"), 2)
    with pytest.raises(ValueError, match="2 numbers"):
        w.write_embeddings(spark.createDataFrame([("n", "a.py", [1.0])], "entity_name string, source_id string, embedding array<float>"), 1)


def test_provisioning_writes_its_tags(spark, tmp_path):
    rec = _export(spark, tmp_path, _node("n", "function"))
    load = lambda: (ndjson.entities(rec), ndjson.relations(rec))
    w = store.Workspace(spark, str(tmp_path / "ws"), "r:ref")
    assert [w.provision("main", sha, load) for sha in ("1", "1", "2")] == ["created", "reused", "rebuilt"]
    other = store.Workspace(spark, str(tmp_path / "ws"), "r:own")
    other.write(*load())
    with pytest.raises(ValueError):
        other.provision("main", "1", load)


def test_refresh_rebuilds_for_another_configuration(spark, tmp_path):
    rec = _export(spark, tmp_path, _node("n", "function"))
    w = store.Workspace(spark, str(tmp_path / "ws"), "x")
    run = lambda **k: w.refresh("auto", ndjson.entities(rec), ndjson.relations(rec), spark.createDataFrame([("a.py",)], "file string"), **k)["mode"]
    assert [run(fingerprint="1", config="a"), run(fingerprint="1", config="a"), run(fingerprint="2", config="a"), run(fingerprint="2", config="b")] == ["rebuild", "noop", "incremental", "rebuild"]


def test_issue_details(spark, rows):
    report = spark.createDataFrame([([("src/a.py", 900, "critical")], [("src/a.py", "f", 80, None)], [("t.py", "sleep", None)], [("src/a.py", 7.5)])], "giant_files array<struct<path: string, lines: int, severity: string>>, giant_functions array<struct<path: string, function_name: string, lines: int, complexity: int>>, test_smells array<struct<path: string, type: string, line_number: int>>, maintainability_scores array<struct<path: string, score: double>>")
    got = {r.category: r for r in debt.static_issues(report).collect()}
    assert got["god_class"].metrics == {"lines": 900, "maintainability_score": 7.5, "total_score": 0} and got["god_function"].metrics["complexity"] == 0 and got["test_smell"].suggestion == "Fix sleep"


def test_ranks(spark):
    r = random.Random(1)
    values = [r.randrange(500) for _ in range(3000)]
    got = ranked(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7), [F.desc("v"), F.asc("i")]).collect()
    assert {x.i: x["rank"] for x in got} == {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)), 1)}
    assert ranked(spark.range(0), ["id"]).count() == 0


def test_warnings_that_leave_a_graph_partial():
    told = ["Parser library not installed for swift: x", "language fingerprint: php", "low resolution", "WARNING: Tests"]
    assert [textlogs.is_partial(w) for w in told] == [True, True, False, False]
    assert textlogs.silenced(told, ["PARSER", " "]) == told[1:] and textlogs.silenced(told, []) == told


def test_resolution_caveat(spark):
    c = lambda x: spark.range(1).select(graph.resolution_caveat(F.lit(x).cast("double"))).first()[0]
    assert c(None) is None and c(0.5) is None and "12.5%" in c(0.125)


def test_callers_are_where_the_symbol_is_called(spark, rows):
    r = spark.createDataFrame(
        [("c", "other", "CALLS", "m.py:10"), ("c", "sym", "CALLS", "m.py:90"), ("c", "sym", "CALLS", "m.py:95"), ("c", "sym", "CALLS", "n.py:7"), ("sym2", "sym", "CALLS", None), ("d", "c", "CALLS", "d.py:1-3"), ("sym", "d", "CALLS", "s.py:x"), ("", "sym", "CALLS", "e.py:1")],
        "src_id string, tgt_id string, keywords string, source_id string",
    )
    symbols = spark.createDataFrame([("sym",), ("sym2",), (None,)], "symbol string")
    assert rows(impact.callers(r, symbols)) == [("c", "m.py", 90, 1), ("c", "n.py", 7, 1), ("d", "d.py", 1, 2), ("sym2", "", 0, 1)]
    assert ("sym", "s.py:x", 0, 3) in rows(impact.callers(r, symbols, 5, full=True))
    assert impact.callers(r, symbols.limit(0)).count() == 0 and impact.callers(r.limit(0), symbols).count() == 0


def test_risk_reason_and_suggestions(spark):
    symbols = spark.createDataFrame([("src/core/a.py",)], "file string")
    found = lambda n, d=1: spark.createDataFrame([(f"c{i}", f"tests/test_{i}.py" if i < 4 else f"x{i}.py", i, d) for i in range(n)], "caller string, file string, line int, distance int")
    r = impact.risk(symbols, found(11)).first()
    assert r.level == "high" and r.reason == "High risk: changes to core module (core), 11 callers affected, 12 modules impacted"
    assert r.suggestions.startswith("Run affected tests: tests/test_0.py, tests/test_1.py, tests/test_2.py (+1 more); ") and "Verify backward compatibility" in r.suggestions
    plain = spark.createDataFrame([("a.ts",)], "file string")
    r = impact.risk(plain, found(0), 0.3).first()
    assert r.level == "medium" and "30.0%" in r.reason and r.suggestions == "Run unit tests for changed modules; Review direct callers for breaking changes"
    assert impact.risk(plain, found(0)).first().reason == "Low risk: no callers found, isolated change"
    assert [impact.caller_risk(found(n)).first().level for n in (0, 3, 10)] == ["low", "medium", "high"]


def test_a_large_frontier_gives_the_same_rows(spark, rows, monkeypatch):
    r = random.Random(4)
    edges = spark.createDataFrame([(r.choice(["hub", *"abcdef"]), r.choice(["hub", *"abcdef"]), r.choice("XY")) for _ in range(40)], "src string, tgt string, kind string")
    seeds = spark.createDataFrame([("hub",), ("a",), ("zz",), (None,)], "seed string")
    want = rows(traverse.bfs(edges, seeds, 3))
    monkeypatch.setattr(traverse, "FRONTIER", 0)
    assert rows(traverse.bfs(edges, seeds, 3)) == want and len(want) > 5


def test_listing_and_warnings(spark, rows):
    df = spark.createDataFrame([(x,) for x in (" M a.py", "R  old.py -> new.py", "plain/b.ts", "", "?? c.md", "a.py")], "line string")
    assert [r[0] for r in rows(textlogs.listing(df, [".py", ".ts"]))] == ["a.py", "new.py", "plain/b.ts"]
    out = spark.createDataFrame([("WARNING: x",), ("Parser library not installed for Java",), ("parser library not installed for java.",), ("fine",)], "line string")
    assert [r[0] for r in rows(textlogs.warning_lines(out))] == ["WARNING: x", "parser missing: java"]


def test_debt(spark, rows, tmp_path):
    report = {"giant_files": [{"path": "src/a.py", "lines": 9, "severity": "critical"}, {"path": "lib/b.py", "lines": 9}], "test_smells": [{"path": "src/t.py", "type": "x"}], "maintainability_scores": [{"path": "src/a.py", "score": 8.0}, {"path": "lib/b.py", "score": 4.0}], "file_reports": [{"file_path": "src/a.py", "issues": [{"category": "large_file"}, {"category": "naming_violation"}, {"category": "other"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    (tmp_path / "e.json").write_text("{}")
    df = reports.read_report(spark, str(tmp_path / "r.json"))
    issues = debt.static_issues(df)
    assert [(r[1], r[2]) for r in rows(issues)] == [("P0", "god_class"), ("P1", "god_class"), ("P2", "test_smell")]
    assert debt.static_issues(df, "src").count() == 2 and debt.maintainability(df).first()[0] == 60
    assert rows(debt.breakdown(df)) == [("src/a.py", 1, 0, 1)]
    assert {r.maintainability for r in debt.with_maintainability(issues, df).collect()} == {8.0, 4.0, 5.0}
    none = reports.read_report(spark, str(tmp_path / "e.json"))
    assert debt.static_issues(none).count() == 0 and debt.maintainability(none).first()[0] is None
    topo = spark.createDataFrame([(80,)], "score int")
    h = debt.health(issues, topo, debt.maintainability(df)).first()
    assert (h.quality, h.total, h.grade) == (84, int(84 * 0.4 + 60 * 0.3 + 80 * 0.3), "C")
    h = debt.health(issues, topo, debt.maintainability(none), spark.createDataFrame([(50,)], "git_score int")).first()
    assert h.total == int((84 * 0.4 + 50 * 0.3) / 0.7) and h.maintainability is None
    assert debt.health(issues.limit(0), spark.createDataFrame([(100,)], "score int")).first().grade == "A"
    assert [r.id for r in debt.numbered(issues).orderBy("id").collect()] == ["debt-001", "debt-002", "debt-003"]
    hot = spark.createDataFrame([("f", 90, 3, 100)] * 4, "file string, score int, commits int, lines int")
    silo = spark.createDataFrame([("f", "critical", "ann", 1, 1.0, 3), ("g", "high", "bob", 2, 0.75, 4)], "file string, risk string, owner string, contributors int, ownership double, commits int")
    assert debt.git_score(hot, silo).first()[0] == 52 and debt.git_issues(hot, silo).count() == 5
    base = spark.createDataFrame([("topology", "P1", "orphan_entity", "e", "f", "x.py:3-9"), ("topology", "P1", "god_function", "g", "f", "x.py:3")], ", ".join(f"{c} string" for c in debt.ISSUE)).withColumns({"confidence": F.lit(None).cast("string"), "suggestion": F.lit("s"), "metrics": F.create_map().cast("map<string,double>")})
    m = spark.createDataFrame([("x.py", 400, 11)], "file string, modified_days int, commits int")
    assert [(r[1], r[6], r[9]) for r in rows(debt.enriched(base, m))] == [("P0", None, True), ("P1", "high", False)]


def test_names(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abc_.") for _ in range(n))
    pairs = [(word(r.randrange(0, 30)), word(r.randrange(0, 30))) for _ in range(60)] + [(word(250), word(260)), ("", ""), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", matching_ratio("a", "b").alias("r"), ratio_bound(F.col("a"), F.col("b")).alias("m")).collect():
        want = 0.0 if x.b is None else SequenceMatcher(None, x.a, x.b).ratio()
        assert x.r == want and want <= x.m + 1e-12


def test_find_and_search(spark, rows):
    e = spark.createDataFrame([("Reader", "class", "a description " * 40, "s"), ("file_reader", "function", "", "s"), ("raeder", "function", None, "s"), ("zzz", "function", "reader", "s"), ("qqqqqqqq", None, None, None), (None, "class", None, None)], "entity_name string, entity_type string, description string, source_id string")
    got = [(r.entity, r.score) for r in search.find(e, "READER").collect()]
    assert got[:3] == [("Reader", 1.0), ("file_reader", 0.9), ("raeder", 0.833)] and got[3] == ("zzz", 0.7) and len(got) == 4
    assert [r.entity for r in search.find(e, "reader", "CLASS").collect()] == ["Reader"] and len(search.find(e, "reader").first().description) == 200
    assert search.find(e, "reader", limit=1).count() == 1
    loop = spark.createDataFrame([("Reader", "Reader"), ("x", "Reader")], "src_id string, tgt_id string")
    assert rows(search.similar({"w": (e, loop)}, "Reader")) == [("w", "Reader", "exact", 2), ("w", "file_reader", "fuzzy", 0), ("w", "raeder", "fuzzy", 0)]
    v = spark.createDataFrame([("Reader", "s", [1.0, 0.0]), ("lost", "s", [0.0, 1.0]), ("short", "s", [1.0]), ("tie", "t", [0.0, 1.0]), ("nul", "s", None)], "entity_name string, source_id string, embedding array<float>")
    assert [(r.entity_name, r.distance) for r in search.knn(v, [0.0, 1.0], 3).collect()] == [("lost", 0.0), ("tie", 0.0), ("Reader", pytest.approx(2**0.5))]
    assert [r.entity_name for r in search.knn(v, [0.0, 1.0], 1, "t").collect()] == ["tie"]
    assert [(r.entity, r.type, r.score) for r in search.search(v, e, [1.0, 0.0], limit=2).collect()] == [("Reader", "class", 1.0), ("lost", "", 0.0)]
    assert [r.entity for r in search.search(v, e, [0.0, 1.0], "class").collect()] == ["Reader"]
    with pytest.raises(ValueError):
        search.knn(v, [])
    emb = search.embed_entities(e, search.hash_embedder(16), batch=2, known=v).collect()
    assert [r.entity_name for r in emb] == ["zzz"] and len(emb[0].embedding) == 16
    assert [x for x in spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(search.normalised(F.col("v"))).collect()[0][0]] == [0.6, 0.8]
    for args in ((None, "a", 1), ("b", "a", 1)):
        with pytest.raises(ValueError):
            search.check_provider(*args)
    search.check_provider(None, "a", 0)


def test_facade(spark, tmp_path):
    q = api.Quarry(spark, str(tmp_path))
    e, r = toy(spark)
    for name in ("one", "two"):
        q.workspace(name).write(e.where("entity_name <> ''").drop("src", "degree"), r.drop("n", "node"))
    assert q.find("one", "b").count() >= 2 and q.graph("one", "a").count() > 0
    assert q.topology("one")["score"].first().score <= 100 and set(q.topology("one", mode="store")) == {"orphans", "hubs", "gods", "stats", "most_coupled", "resolution"}
    assert q.debt("one")["health"].first().grade in "ABCDF" and q.compare("one", "two")["summary"].first().relations_diff == 0
    assert q.embed_backfill("one", search.hash_embedder(8), "hash", 8) == 0
    audit = q.debt_audit("one")
    assert all(v["error"] is None for v in audit.values()) and set(q.evolution_track("a", ["one", "two"])) == {"similar", "compare one two", "graph one", "graph two"}
    assert q.sync_advice("one", "two", ["c"])["callers c"]["data"].count() > 0 and q.similar("a").count() >= 2
    assert api.envelope(lambda: q.info("one"))["success"] and api.envelope(lambda: 1 / 0)["error"]["code"] == "ZeroDivisionError"
    assert api.markdown(q.info("one")).startswith("| tab | kind | n |") and api.chart([1, 2, 3], 3) == "  *\n *\n*"
    path = tmp_path / "e.ndjson"
    path.write_text("\n".join(json.dumps(x) for x in [_node("n.f", "function", "n.py:1-9"), _node("n.g", "function", "n.py:11-19"), _edge("n.g", "n.f", line="n.py:12")]))
    with pytest.raises(ValueError):
        q.provision("one", "main", "abc", str(path))
    assert q.provision("snap", "main", "abc", str(path)) == "created" and q.provision("snap", "main", "abc", str(path)) == "reused"
    assert q.update("three", str(path), fingerprint="1")["mode"] == "rebuild" and q.update("three", str(path), fingerprint="1") == {"mode": "noop"}
    (tmp_path / "d.diff").write_text("diff --git a/n.py b/n.py\n@@ -3,1 +3,1 @@\n-x\n+y\n")
    hit = q.impact_of_diff("three", str(tmp_path / "d.diff"))
    assert [r.name for r in hit["symbols"].collect()] == ["n.f"] and [(r.caller, r.line) for r in hit["callers"].collect()] == [("n.g", 12)]
    (tmp_path / "log.txt").write_text("abcd1|ann|100|fix: x\n3\t1\tn.py\n")
    assert q.git_metrics_of_log(str(tmp_path / "log.txt"))["files"].first().author_list == ["ann"]
    assert q.branch_summary("three", "snap")["summary"].first().entities_shared == 2


def test_stream(spark, rows, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.ndjson").write_text("\n".join(map(json.dumps, NDJSON[:6])))
    w = store.Workspace(spark, str(tmp_path / "ws"), "s")
    for _ in range(2):
        ingest_stream(spark, str(folder), w, str(tmp_path / "cp")).awaitTermination()
    assert w.table("entities").count() == 2 and w.table("relations").count() == 2
    (folder / "2.ndjson").write_text(json.dumps(NDJSON[1] | {"description": "new"}))
    ingest_stream(spark, str(folder), w, str(tmp_path / "cp")).awaitTermination()
    assert "new" in {r[0].split(" | ")[-1] for r in rows(w.table("entities").select("description"))}
    ev = spark.createDataFrame([(datetime(2025, 1, 1, 1, 5), "a", 1.0), (datetime(2025, 1, 1, 1, 55), "a", 2.0), (datetime(2025, 1, 1, 2), "a", None)], "ts timestamp, event_type string, value double")
    assert [(r.n, r.value) for r in windowed_counts(ev).orderBy("start").collect()] == [(2, 3.0), (1, None)]


def test_snapshot_files(spark, rows, tmp_path):
    s = spark.createDataFrame([("a b", "f", datetime(2025, 1, 1), {"c": 1.0}, "w"), ("c", "f", datetime(2025, 1, 2), {"c": 2.0}, "w")], "entity string, entity_type string, timestamp timestamp, metrics map<string,double>, workspace string")
    for _ in range(2):
        reports.save_snapshots(s, str(tmp_path / "s"))
    assert reports.slug("a b").startswith("a_b_") and (tmp_path / "s" / f"slug={reports.slug('a b')}").is_dir()
    back = reports.read_snapshots(spark, str(tmp_path / "s"))
    assert back.count() == 4 and rows(history.dedupe_snapshots(back.select(*s.columns)).select("entity", "metrics")) == rows(s.select("entity", "metrics"))
    (tmp_path / "one.json").write_text(json.dumps({"entity": "e", "timestamp": "2025-01-01T00:00:00", "metrics": {"c": 1}}, indent=1))
    (tmp_path / "bad.json").write_text("{oops")
    assert [r.entity for r in reports.read_snapshots(spark, str(tmp_path / "*.json"), whole_files=True).collect()] == ["e"]
