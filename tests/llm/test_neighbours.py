import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import neighbours
from quarrygraph.llm.vamana import Graph

SCHEMA = "vec_id bigint, entity_name string, source_id string, embedding array<float>"


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1)[:, :k]


def frame(spark, names, x):
    return spark.createDataFrame([(i, n, None, None if v is None else [None if a is None else float(a) for a in v]) for i, (n, v) in enumerate(zip(names, x, strict=True))], SCHEMA).withColumn("id", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("name", F.lit("clash"))


@pytest.mark.parametrize("n", [1, 2, 5, 60, 1500])
def test_graph_recall(n):
    x = np.random.default_rng(n).normal(size=(n, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, sims = Graph(x).search(x, 40, min(11, n))
    assert (ids[:, 0] == np.arange(n)).mean() > 0.99 and np.allclose(sims[:, 0].max(), 1, atol=1e-5)
    if n > 20:
        _, want = brute(x, 10)
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want, strict=True)]) >= 0.9


def test_recall_and_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    x[::10] = x[1::10] + rng.normal(size=(150, 64)) * 0.05
    names = [f"n{i:04d}" for i in range(1500)]
    sims, want = brute(x.astype(np.float32).astype(float), 10)
    at = {n: i for i, n in enumerate(names)}
    got = neighbours.most_similar(frame(spark, names, x)).collect()
    assert len(got) == 15_000
    assert np.mean([at[r.other] in want[at[r.name]] for r in got]) >= 0.9
    assert max(abs(r.cosine - sims[at[r.name], at[r.other]]) for r in got) < 1e-6
    pairs = {(r.name_a, r.name_b) for r in neighbours.similar_pairs(frame(spark, names, x)).collect()}
    assert pairs == {tuple(sorted((names[i], names[j]))) for i in range(1500) for j in want[i] if sims[i, j] >= 0.97}


def recall_in_cells(spark, monkeypatch, x, cells, dims=64):
    """Recall of the ten nearest when about so many cells are forced, and the number of cells asked."""
    monkeypatch.setattr(neighbours, "CELL", -(-neighbours.MEMBER_OF * len(x) // cells))
    asked, real = [], neighbours.cells_to_ask
    monkeypatch.setattr(neighbours, "cells_to_ask", lambda *a: asked.append((len(a[3].fine), real(*a))) or asked[-1][1])
    names = [f"n{i:05d}" for i in range(len(x))]
    sims, _ = brute(x.astype(np.float32).astype(float), 10)
    least = np.sort(sims, axis=1)[:, -10]
    at = {n: i for i, n in enumerate(names)}
    got = neighbours.most_similar(frame(spark, names, x), dims=dims).collect()
    assert len(got) == 10 * len(x) == len({(r.name, r.other) for r in got})
    return np.mean([sims[at[r.name], at[r.other]] >= least[at[r.name]] - 1e-9 for r in got]), asked[0]


@pytest.mark.parametrize("cells", [3, 30])
def test_recall_with_cells_of_clustered_vectors(spark, monkeypatch, cells):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 64)) * 0.5
    recall, (made, asked) = recall_in_cells(spark, monkeypatch, x, cells)
    assert recall >= 0.9 and made >= cells * 0.7 and asked < max(3, made * 0.6)


def test_recall_with_cells_of_vectors_without_order(spark, monkeypatch):
    """Neighbours lie in any cell: nearly all are asked then."""
    recall, (made, asked) = recall_in_cells(spark, monkeypatch, np.random.default_rng(8).normal(size=(2400, 64)), 16)
    assert recall >= 0.9 and made >= 12 and asked >= made / 2


def test_one_dense_region_is_split(spark, monkeypatch):
    """Most vectors in one place, those of few numbers apart: cells follow the density and the largest parts stay bounded."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(1800, 64)) * 0.02, rng.normal(size=(600, 64))])
    recall, _ = recall_in_cells(spark, monkeypatch, x, 16)
    assert recall >= 0.9
    reps = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    routed, shards = neighbours._routed(reps, len(x), 64, 10)
    sizes = [r["count"] for r in routed.where("role = 0").groupBy("shard").count().collect()]
    assert sum(sizes) == 2 * len(x) and max(sizes) <= 3 * neighbours.CELL and len(sizes) <= shards


def test_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "COPIES_PART", 20)
    rng = np.random.default_rng(6)
    hot, twin = rng.normal(size=64), rng.normal(size=64)
    names = [f"hot{i:03d}" for i in range(90)] + ["twin1", "twin2", "near"] + [f"o{i}" for i in range(30)]
    x = [hot] * 90 + [twin, twin, twin + rng.normal(size=64) * 0.01] + list(rng.normal(size=(30, 64)))
    got = neighbours.most_similar(frame(spark, names, x)).collect()
    by = {}
    for r in got:
        by.setdefault(r.name, []).append((r.other, r.cosine))
    assert by.keys() == set(names) and all(len(v) == 10 == len({o for o, _ in v}) for v in by.values())
    assert all(o.startswith("hot") and c == 1 for n in names[:90] for o, c in by[n])
    assert {o for o, _ in by["twin1"][:2]} == {"twin2", "near"}
    pairs = {(r.name_a, r.name_b) for r in neighbours.similar_pairs(frame(spark, names, x)).collect()}
    assert {("twin1", "twin2"), ("near", "twin1"), ("near", "twin2")} <= pairs


def test_unusable_counted_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    names = ["a", "b", "null", "short", "nan", "inf", "zero", "hole", None, "late", "late", "empty", ""]
    good = [1.0] + [0.5] * 63
    vecs = [good, good, None, [1.0], [nan] + good[1:], [inf] + good[1:], [0.0] * 64, [None] + good[1:], good, good, [0.0] * 64, [], good]
    got = neighbours.most_similar(frame(spark, names, vecs)).collect()
    assert {(r.name, r.other) for r in got} == {(x, y) for x in ("a", "b", "") for y in ("a", "b", "") if x != y}
    assert neighbours.most_similar(frame(spark, names, vecs).limit(0)).count() == 0
    assert neighbours.most_similar(frame(spark, ["x"], [good])).count() == 0


def test_huge_and_tiny_numbers(spark):
    x = [[3e38] * 64, [1e-40] * 64, [1.0] * 63 + [-1.0]]
    got = {(r.name, r.other): r.cosine for r in neighbours.most_similar(frame(spark, ["big", "small", "c"], x)).collect()}
    assert got[("big", "small")] == pytest.approx(1, abs=1e-3)
