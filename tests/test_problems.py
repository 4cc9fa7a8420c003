"""The general problems: small cases and brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrygraph.functions.canonical import compared, properties
from quarrygraph.operators import changes, copies, hierarchy, joins, nodes, references
from quarrygraph.operators.counted import counted

REL = "ord bigint, src_id string, tgt_id string, keywords string, weight double, resolution_qualifier string, source_id string, indexed_at timestamp_ntz"
ENT = "entity_name string, entity_type string, description string, source_id string, properties_json string, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def rel(spark, data):
    rows = [(o, s, t, k, w, q, None, None if at is None else T0 + timedelta(days=at)) for o, s, t, k, w, q, at in data]
    return spark.createDataFrame(rows, REL).withColumn("side", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("name", F.lit("x"))


def ent(spark, data):
    return spark.createDataFrame([(n, "t", None, None, p, None if a is None else T0 + timedelta(days=a), None if x is None else T0 + timedelta(days=x)) for n, p, a, x in data], ENT)


def test_counted_latest_ties_nulls(spark, rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (2, None, "q"), (None, 9, "n")], "k int, t int, v string").withColumn("_row", F.lit(0))
    assert rows(counted(df, ["k"], "t", ["v"])) == [(1, 5, "b"), (2, None, "q")]
    assert counted(df.limit(0), ["k"], "t", ["v"]).count() == 0


def test_spread_join_equals_join(spark, rows):
    r = random.Random(3)
    data = [(r.choice(["hot"] * 5 + ["a", "b", "c", None, "gone"]), i) for i in range(300)]
    facts, dims = spark.createDataFrame(data, "k string, i int"), spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("z", 9)], "k string, v int")
    counts = facts.groupBy("k").count()
    for how in ("inner", "left"):
        assert rows(joins.spread_join(facts, dims, "k", counts, "count", how)) == rows(facts.join(dims, "k", how).select("k", "i", "v"))


def test_node_profile(spark, rows):
    df = rel(spark, [(1, "a", "b", "CALLS", 1.0, None, 0), (1, "a", "c", "CALLS", 9.0, None, -1), (1, "a", "b", "CALLS", 1.0, None, 0), (2, "a", "", " calls", None, None, 1), (3, "a", "b", "IMPORTS", 0.5, None, None), (None, "x", "y", "k", 1.0, None, 0), (4, None, "b", None, 2.0, None, 0)])
    got = {(r.side, r.node): r for r in nodes.node_profile(df).collect()}
    assert set(got) == {("src", "a"), ("tgt", "b"), ("tgt", "")}
    a, b = got[("src", "a")], got[("tgt", "b")]
    assert (a.edges, a.kinds, a.weighted, a.weight_sum) == (3, 2, 2, 1.5)
    assert (b.edges, b.kinds, b.weight_min, b.weight_max) == (3, 3, 0.5, 2.0)
    assert nodes.node_profile(df.limit(0)).count() == 0


def test_heavy_nodes_threshold(spark, rows):
    data = [(i, f"s{i}", "hub" if i < 2 else f"t{i}", "", None, None, 0) for i in range(100)]
    assert rows(nodes.heavy_nodes(rel(spark, data))) == [("tgt", "hub")]
    assert rows(nodes.heavy_nodes(rel(spark, data), 1))[:1] == [("src", "s0")]
    assert nodes.heavy_nodes(rel(spark, data).limit(0)).count() == 0


def test_broken_references(spark, rows):
    relations = rel(
        spark,
        [
            (1, "live", "gone", "C", None, "resolved", 10),
            (2, "late", "stub", "C", None, None, 10),
            (3, "deleted", "expr", "C", None, "unresolved", 10),
            (4, "", "<unresolved>", "C", None, "resolved", 10),
            (5, "late", "live", "C", None, "resolved", None),
            (6, "back", "late", "C", None, "resolved", 99),
            (7, "gone", "gone", "C", None, "resolved", 3),
            (7, "live", "live", "C", None, "resolved", 2),
        ],
    )
    entities = ent(spark, [("live", None, 1, None), ("late", None, 20, None), ("late", None, 30, None), ("deleted", None, 1, 5), ("back", None, 1, 4), ("back", None, 6, None), (None, None, 1, None)])
    stubs = spark.createDataFrame([("stub",), (None,)], "entity_name string")
    got = rows(references.broken_references(relations, entities, stubs).select("ord", "side", "state"))
    assert got == [(1, "tgt", "missing"), (2, "src", "late"), (3, "src", "deleted"), (7, "src", "missing"), (7, "tgt", "missing")]
    report = rows(references.broken_report(relations, entities, stubs))
    assert ("relations", "src", "2025-01", "late", 1) in report and sum(r[4] for r in report) == 5
    assert references.broken_references(relations.limit(0), entities, stubs).count() == 0
    assert references.broken_references(relations, entities.limit(0), stubs.limit(0)).count() == 11


def test_broken_report_counts_as_the_rows_do(spark, rows):
    r = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    relations = rel(spark, [(i, r.choice(names), r.choice(names), "C", None, r.choice([None, "resolved", "unresolved"]), r.choice([None, *range(0, 90, 7)])) for i in range(400)])
    entities = ent(spark, [(n, None, r.choice([None, *range(0, 95, 5)]), r.choice([None, None, None, 3])) for n in names[:9] for _ in range(2)])
    stubs = spark.createDataFrame([("n9",), ("n0",)], "entity_name string")
    found = references.broken_references(relations, entities, stubs)
    want = Counter((x.side, x.at.strftime("%Y-%m") if x.at else "", x.state) for x in found.collect())
    got = references.broken_report(relations, entities, stubs).collect()
    assert {(g.side, g.month, g.state): g.n for g in got} == want and {k[2] for k in want} == {"missing", "deleted", "late"}


def brute_tree(parent):
    out = {}
    for v in parent:
        path, at, u = [v], {v: 0}, v
        while u in parent and parent[u] not in at:
            u = parent[u]
            at[u] = len(path)
            path.append(u)
        if u in parent:
            ring = path[at[parent[u]] :]
            out[v] = (min(ring), -1 if v in ring else -2)
        else:
            out[v] = (u, len(path) - 1)
    return out


def check_tree(spark, parent, extra=()):
    links = spark.createDataFrame([*parent.items(), *extra], "child string, parent string").withColumn("size", F.lit(1)).withColumn("jump", F.lit("x"))
    tree = hierarchy.hierarchy(links)
    got = {r.node: r for r in tree.collect()}
    assert {(r.node, r.parent, r.root, r.depth, r.size) for r in hierarchy.depths(links).collect()} == {(n, r.parent, r.root, r.depth, r.size) for n, r in got.items()}
    want = brute_tree(parent)
    assert {n: (r.root, r.depth) for n, r in got.items() if r.parent is not None} == want
    kids = defaultdict(set)
    for v, (_, d) in want.items():
        u = v
        for _ in range(max(d, 0)):
            u = parent[u]
            kids[u].add(v)
    by_pos = defaultdict(dict)
    for n, r in got.items():
        if r.lft is not None:
            by_pos[r.root][r.lft] = n
    for n, r in got.items():
        if r.lft is not None:
            assert {by_pos[r.root][p] for p in range(r.lft + 1, r.rgt + 1)} == kids[n]
            assert r.size == len(kids[n]) + 1
    assert {(r.ancestor, r.node) for r in hierarchy.descendants(tree).collect()} == {(a, v) for a, vs in kids.items() for v in vs}
    return tree


def test_hierarchy_shapes(spark, rows):
    chain = {f"n{i:03d}": f"n{i + 1:03d}" for i in range(70)}
    tree = check_tree(spark, chain | {f"leaf{i}": "n050" for i in range(30)} | {"self": "self", "to_self": "self", "x": "y", "y": "z", "z": "x", "in1": "x", "in2": "in1", "": "n001"}, [("n000", "n001"), (None, "a"), ("a", None)])
    path = dict(rows(hierarchy.paths(tree)))
    assert path["n068"] == "n070 > n069 > n068" and path[""].endswith("n001 > ")
    assert "x" not in path


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy_random(spark, seed):
    r = random.Random(seed)
    names = [f"v{i}" for i in range(60)]
    check_tree(spark, {v: r.choice(names) for v in names if r.random() < 0.9})


def test_hierarchy_empty_and_many_parents(spark, rows):
    empty = spark.createDataFrame([], "child string, parent string")
    assert hierarchy.hierarchy(empty).count() == 0
    assert rows(hierarchy.hierarchy(spark.createDataFrame([("c", "b"), ("c", "a")], "child string, parent string")).where("parent IS NOT NULL").select("node", "parent")) == [("c", "a")]


def test_descendants_of_one_large_root_are_spread(spark):
    tree = spark.range(200_000).select(F.lit("r").alias("root"), F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") > 0, "n0").alias("parent"), F.least("id", F.lit(1)).alias("depth"), F.when(F.col("id") > 0, 1).otherwise(200_000).alias("size"), F.col("id").alias("lft"), F.when(F.col("id") > 0, F.col("id")).otherwise(199_999).alias("rgt"))
    found = hierarchy.descendants(tree)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    told = found.groupBy("ancestor").agg(F.count("*").alias("n"), F.countDistinct("node").alias("d"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).collect()
    assert [tuple(r) for r in told] == [("n0", 199_999, 199_999, 1, 1)]


def test_hierarchy_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "HOT_FOLLOWERS", 5)
    check_tree(spark, {f"c{i}": "mid" for i in range(40)} | {"mid": "top", "top": "root"} | {"l1": "l2", "l2": "l1", **{f"t{i}": "l1" for i in range(9)}})


def test_inheritance_links(spark, rows):
    df = rel(spark, [(1, "a", "b", " Inherits\t", None, None, 0), (2, "a", "b", "EXTENDS", None, "resolved", 0), (3, "a", "c", "INHERITS", None, "ambiguous", 0), (4, "a", "", "inherits", None, None, 0), (5, "a", "<unresolved>", "inherits", None, None, 0), (6, "a", "d", "CALLS", None, None, 0), (7, "e", "f", "inherits", None, "unresolved", 1), (7, "e", "f", "inherits", None, "resolved", 0)])
    assert rows(hierarchy.inheritance_links(df)) == [("a", "b"), ("a", "b")]


JSON_SAME = [('{"a":1,"b":"x"}', '{"b":"x" , "a":1.0}'), ('{"a":null}', "{}"), ('{"a":""}', None), ('{"n":{"y":2,"x":[1,2]}}', '{"n":{"x":[1.0,2],"y":2e0}}'), ('{"s":"\\u00e9"}', '{"s":"é"}'), ("", None), ("null", None), ('{"a":{"b":null}}', '{"a":{}}')]
JSON_OTHER = [('{"a":1}', '{"a":2}'), ('{"a":[1,2]}', '{"a":[2,1]}'), ('{"a":true}', '{"a":1}'), ('{"a":"1"}', '{"a":1}'), ("{", "{}"), ("{'a':1}", '{"a":1}'), ('{"a":NaN}', "{}")]


def test_properties():
    for a, b in JSON_SAME:
        assert properties(a) == properties(b) is not None
    for a, b in JSON_OTHER:
        assert properties(a) != properties(b)


def test_native_comparison_equals_pythons(spark):
    r = random.Random(7)
    value = lambda: r.choice(["1", "1.0", "1e0", "-0", "0", "0.0", '"1"', '"x"', '"\\u0078"', '""', "null", "true", "false", "[]", "[1,2]", "[1.0,2]", '["",null]', "[null,null]", '["a"]', '[ "a" ]', "{}", '{"b":1}', '{"b":1.0,"c":null}', "1e400", '"Infinity"', "12345678901234567", "12345678901234568", "0.30000000000000004", "0.3", '"\\ud800"', '"}{"', '"\\""', "NaN", "01"])
    text = lambda: r.choice(["{%s}", " {%s} ", "{%s} x", "{%s}{}", "{%s},{}", "[%s]", "%s", "{%s}\x00"][: r.choice([2, 2, 2, 8])]) % ", ".join(f'"{k}":{value()}' for k in r.sample(["a", "b", "", "é"], r.randrange(0, 3)))
    pairs = [(text(), text()) for _ in range(1500)] + [(text(), None) for _ in range(60)] + [(None, text()) for _ in range(60)] + [("", " "), (None, None), ('{"a":1,"a":2}', '{"a":2}'), *JSON_SAME, *JSON_OTHER]
    df = spark.createDataFrame([(i, a, b, "clash") for i, (a, b) in enumerate(pairs)], "i int, a string, b string, _keys string").drop("_keys")
    got = {x.i: x.d for x in compared(df, F.col("a"), F.col("b"), "d", "props").collect()}
    for i, (a, b) in enumerate(pairs):
        p, q = properties(a), properties(b)
        want = [] if a == b else ["props"] if p is None or q is None else [f"props.{k}" for k in sorted(p.keys() | q.keys()) if p.get(k) != q.get(k)]
        assert got[i] == want, (a, b)


def snaps(spark, data):
    return spark.createDataFrame([(n, k, t, None, None, p, T0 + timedelta(minutes=at)) for n, k, t, p, at in data], "snap_no int, entity_name string, entity_type string, description string, source_id string, properties_json string, delivered_at timestamp_ntz").withColumn("rank", F.lit(7)).withColumn("last", F.lit(7))


def test_entity_changes(spark, rows):
    df = snaps(
        spark,
        [
            (3, "a", "c", None, 0), (5, "a", "c", "{}", 0), (9, "a", "d", None, 0),
            (3, "b", "c", None, 0), (9, "b", "c", None, 0),
            (5, "n", "c", '{"x":1}', 0), (9, "n", "c", '{"x": 1.0}', 0),
            (9, "late", "x", None, 0), (3, "gone", "x", None, 0), (3, "gone", "x", None, 0),
            (3, "dup", "old", None, 0), (3, "dup", "new", None, 5), (5, "dup", "new", None, 0), (5, "dup", "bad", None, -9), (9, "dup", "new", None, 1),
            (None, "nowhere", "x", None, 0),
        ],
    )
    got = [(r[0], r[2], r[5]) for r in rows(changes.entity_changes(df))]
    assert sorted(got) == sorted([(9, "a", "changed"), (5, "b", "removed"), (9, "b", "added"), (5, "n", "added"), (9, "late", "added"), (5, "gone", "removed")])
    assert changes.entity_changes(df.limit(0)).count() == 0


def test_relation_changes_tolerance(spark, rows):
    base = [(1, "a", "b", "k", 1.0, None), (2, "a", "b", "k", 1.0 + 5e-10, ""), (3, "a", "b", "k", 1.0 + 2e-9, ""), (4, "a", "b", "k", None, ""), (1, "x", "y", "k", float("nan"), "q"), (2, "x", "y", "k", float("nan"), "q")]
    df = spark.createDataFrame([(*r, None, T0) for r in base], "snap_no int, src_id string, tgt_id string, keywords string, weight double, resolution_qualifier string, source_id string, delivered_at timestamp_ntz")
    assert [(r[0], r[2], r[5]) for r in rows(changes.relation_changes(df))] == [(3, "a", "changed"), (3, "x", "removed"), (4, "a", "changed")]


def test_many_snapshots_without_broadcast(spark, rows, monkeypatch):
    df = snaps(spark, [(n, f"k{i}", str(n // (i + 1)), None, 0) for n in range(6) for i in range(5) if (n + i) % 4])
    want = rows(changes.entity_changes(df))
    monkeypatch.setattr(changes, "MOST_SNAPSHOTS", 1)
    assert rows(changes.entity_changes(df)) == want and want


def test_changes_against_brute_force(spark, rows):
    r = random.Random(11)
    data = [(n, f"k{i}", r.choice(["", None, "a", "b"]), r.choice([None, "", '{"p":1}', '{"p":1.0}', '{"p":2}']), 0) for n in (2, 3, 7, 8) for i in range(25) if r.random() < 0.7]
    state = {n: {k: (t or "", json.dumps(properties(p))) for m, k, t, p, _ in data if m == n} for n in (2, 3, 7, 8)}
    want = []
    for a, b in ((2, 3), (3, 7), (7, 8)):
        for k in state[a].keys() | state[b].keys():
            if state[a].get(k) != state[b].get(k):
                want.append((b, k, "added" if k not in state[a] else "removed" if k not in state[b] else "changed"))
    assert sorted((x[0], x[2], x[5]) for x in rows(changes.entity_changes(snaps(spark, data)))) == sorted(want)


def test_copy_differences(spark, rows):
    main = ent(spark, [("same", '{"a":1,"b":""}', 1, None), ("diff", '{"a":1,"n":{"x":1},"t":[1,2]}', 1, None), ("bad", "{oops", 1, None), ("both_bad", "{oops", 1, None), ("only", None, 1, None), ("old", '{"a":1}', 1, None), ("old", '{"a":2}', 2, None), (None, None, 1, None)])
    mirror = ent(spark, [("same", '{ "a" : 1.0 }', 5, None), ("diff", '{"n":{"x":2},"t":[2,1],"z":0}', 1, None), ("bad", "{}", 1, None), ("both_bad", "{oops", 9, None), ("other", None, 1, None), ("old", '{"a":2}', 0, None)]).withColumn("description", F.lit("")).drop("deleted_at")
    got = rows(copies.entity_differences(main, mirror))
    want = [("bad", "properties_json", "differs"), *[("diff", f"properties_json.{p}", "differs") for p in "antz"], ("only", "", "only_main"), ("other", "", "only_mirror")]
    assert [r[1:] for r in got] == want
    assert Counter(r[3] for r in rows(copies.entity_differences(main, mirror.limit(0)))) == {"only_main": 6}
    assert copies.entity_differences(main.limit(0), mirror.limit(0)).count() == 0


def test_relation_differences(spark, rows):
    main = rel(spark, [(1, "a", "b", "k", 1.0, None, 1), (2, "a", "b", "k", 1.0, "", 1), (3, "a", "b", "k", None, None, 1), (4, "a", "b", "k", None, None, 1), (None, "a", "b", "k", None, None, 1)])
    mirror = rel(spark, [(1, "a", "b", "k", 1.0 + 1e-10, "", 3), (2, "a", "c", "K", 1.1, None, 1), (3, "a", "b", "k", 0.0, None, 1), (5, "a", "b", "k", None, None, 1)])
    assert [r[1:] for r in rows(copies.relation_differences(main, mirror))] == [("2", "keywords", "differs"), ("2", "tgt_id", "differs"), ("2", "weight", "differs"), ("3", "weight", "differs"), ("4", "", "only_main"), ("5", "", "only_mirror")]
