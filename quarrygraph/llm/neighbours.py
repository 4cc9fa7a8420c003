"""The most similar vectors of every vector (problem 6).

Equal vectors are merged first: one representative each, so a group of copies, however large, is searched once. The
representatives are routed by centroids into overlapping cells, in the same way at every size: a vector is a member of
its MEMBER_OF nearest cells and asks some more of its nearest ones. Each cell builds a robust-pruned directed graph
(``vamana``) over its members and answers beam searches of all that ask it. Each vector's answers are merged by cosine.

How many cells are asked is measured, not assumed: for PROBES vectors the true neighbours are found in the whole table,
and the least number of cells that holds REACH of them is taken. Vectors that form clusters need about four, vectors
without any order nearly all. The number of cells follows the number of vectors, so with clusters every vector costs the
same number of insertions and searches whatever the size of the table or the cluster. A cell that holds more than its
share is split by hash into parts, all of which are asked: nothing is dropped to keep cells even.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.llm.vamana import Graph
from quarrygraph.operators.counted import counted
from quarrygraph.operators.joins import spread_join
from quarrygraph.session import Scratch

#: Members wanted per cell; a cell of more than twice as many is split into parts.
CELL = 4_000
MEMBER_OF = 2
#: Vectors whose true neighbours are looked up to choose the number of cells to ask, and the share of these to be in reach.
PROBES = 400
REACH = 0.97
#: Centroids are found on two levels: at most TOPS coarse ones, and MOST_CELLS in all (17 MB of 64 numbers, broadcast).
#: The fine ones of at least this many coarse ones near a vector are compared with it.
TOPS = 256
MOST_CELLS = 65_536
NEAR_TOPS = 8
#: Centroids are fitted on about so many vectors per cell, chosen by hash; all vectors are indexed and searched.
SAMPLE_PER_CELL = 24
TOP_SAMPLE = 20_000
ROUNDS = 6
BEAM = 40
QUERY_BLOCK = 128
#: Copies of a large group are dealt into parts of about this many before they are linked.
COPIES_PART = 10_000


def usable(embedding: Column, dims: int) -> Column:
    """Not null, exactly ``dims`` finite numbers, not all zero."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(embedding) == dims) & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _unit(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _search(k: int, dims: int, beam: int):  # noqa: ANN202
    """For mapInArrow over rows sorted by (shard, role): builds a shard's graph from its members (role 0) and answers them and the queries that follow."""

    def answers(graph: Graph, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: np.ndarray) -> pa.RecordBatch:
        near, cos = [], []
        for lo in range(0, len(q), QUERY_BLOCK):
            part = q[lo : lo + QUERY_BLOCK]
            at, _ = graph.search(part.astype(np.float32), max(beam, k + 1), k + 1)
            # summed along the last axis, so that a pair has the very same cosine in every cell
            exact = (x[np.maximum(at, 0)] * part[:, None, :]).sum(axis=2)
            other = np.where(at >= 0, ids[np.maximum(at, 0)], qid[lo : lo + QUERY_BLOCK, None])
            near.append(other)
            cos.append(np.where(other == qid[lo : lo + QUERY_BLOCK, None], -2.0, exact))
        other, c = np.concatenate(near), np.concatenate(cos)
        order = np.argsort(-c, axis=1, kind="stable")[:, :k]
        other, c = np.take_along_axis(other, order, 1), np.take_along_axis(c, order, 1)
        ok = c > -2
        off = np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(c[ok]), pa.array(other[ok])], ["cosine", "other"])
        return pa.RecordBatch.from_arrays([pa.array(qid), pa.ListArray.from_arrays(pa.array(off), found)], ["id", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph, x, ids = None, None, None, None
        members: list[tuple[np.ndarray, np.ndarray]] = []

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal graph, x, ids, members
            if members:
                ids, x = np.concatenate([m[0] for m in members]), np.concatenate([m[1] for m in members])
                members, graph = [], Graph(x.astype(np.float32))
                yield answers(graph, x, ids, x, ids)

        for batch in batches:
            at = batch["shard"].to_numpy().astype(np.int64) * 2 + batch["role"].to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                part, now, role = batch.slice(lo, hi - lo), int(at[lo]) // 2, int(at[lo]) % 2
                if now != shard:
                    yield from built()
                    shard, graph = now, None
                rows, vectors = part["id"].to_numpy(), _unit(part["embedding"], dims)
                if role == 0:
                    members.append((rows.copy(), vectors))
                    continue
                yield from built()
                if graph is not None:
                    yield answers(graph, x, ids, vectors, rows)
        yield from built()

    return run


def _nearest_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[lo : lo + 8192] @ centroids.T).argmax(1) for lo in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """At most ``k`` unit centroids of the unit vectors ``x``. Seeded with vectors drawn at random, so that dense regions get more of them."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest_of(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.where(norm > 1e-9, norm, 1), c)
    return c


@dataclass
class Cells:
    """Centroids on two levels: ``fine[first[t]:first[t + 1]]`` belong to the coarse ``top[t]``."""

    top: np.ndarray
    fine: np.ndarray
    first: np.ndarray

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The up to ``n`` nearest cells of each vector, nearest first; -1 where there are no more."""
        n = min(n, len(self.fine))
        tops = min(len(self.top), max(NEAR_TOPS, math.ceil(4 * n * len(self.top) / len(self.fine))))
        sim = x @ self.top.T
        near = np.argpartition(-sim, tops - 1, axis=1)[:, :tops]
        best = np.full((len(x), n), -np.inf, np.float32)
        cell = np.full((len(x), n), -1, np.int64)
        for t in np.unique(near):
            rows = np.flatnonzero((near == t).any(1))
            own = np.arange(self.first[t], self.first[t + 1])
            s = np.concatenate([best[rows], x[rows] @ self.fine[own].T], 1)
            c = np.concatenate([cell[rows], np.broadcast_to(own, (len(rows), len(own)))], 1)
            order = np.argsort(-s, axis=1, kind="stable")[:, :n]
            best[rows], cell[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(c, order, 1)
        return cell


def fit_cells(reps: DataFrame, n: int, dims: int, wanted: int) -> Cells:
    """About ``wanted`` centroids fitted on a bounded sample of ``reps``: at most about TOP_SAMPLE vectors in the driver for the coarse ones,
    SAMPLE_PER_CELL per cell, grouped by coarse centroid, for the fine ones."""
    spark = reps.sparkSession
    mark = F.pmod(F.xxhash64(F.lit(3), "embedding"), F.lit(1 << 30))
    drawn = lambda rows: reps.where(mark < F.lit(min(1 << 30, math.ceil((1 << 30) * rows / n)))).select("embedding")
    sample = _unit(drawn(min(TOP_SAMPLE, SAMPLE_PER_CELL * wanted + 1000)).limit(2 * TOP_SAMPLE).toArrow()["embedding"], dims).astype(np.float32)
    sample = sample[np.lexsort(sample.T[::-1])]
    top = kmeans(sample, min(TOPS, math.ceil(math.sqrt(wanted))))
    shared = spark.sparkContext.broadcast(top)
    total = min(n, SAMPLE_PER_CELL * wanted + 1000)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_nearest_of(_unit(b["embedding"], dims).astype(np.float32), shared.value).astype(np.int32)), b["embedding"]], ["top", "embedding"])

    def fine(group: pa.Table) -> pa.Table:
        x = _unit(group["embedding"], dims).astype(np.float32)
        x = x[np.lexsort(x.T[::-1])]
        c = kmeans(x, math.ceil(wanted * len(x) / total))
        return pa.table({"top": pa.array(np.full(len(c), group["top"][0].as_py(), np.int32)), "c": pa.array(list(c), pa.list_(pa.float32()))})

    made = drawn(total).mapInArrow(tops, "top int, embedding array<float>").groupBy("top").applyInArrow(fine, "top int, c array<float>").toArrow()
    at = made["top"].to_numpy()
    c = made["c"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
    order = np.lexsort([*c.T[::-1], at])
    at, c = at[order], c[order]
    used = np.unique(at)
    return Cells(top[used], c, np.concatenate([np.searchsorted(at, used), [len(at)]]))


def _assigned(cells: Cells | None, x: np.ndarray, n: int) -> np.ndarray:
    return np.zeros((len(x), 1), np.int64) if cells is None else cells.nearest(x.astype(np.float32), n)


def cells_to_ask(reps: DataFrame, n: int, dims: int, cells: Cells, k: int) -> int:
    """The least number of nearest cells (of 2, 3, 4, 6, 8, 12 ...) that hold, as members, at least REACH of the true ``k`` neighbours of PROBES vectors."""
    spark = reps.sparkSession
    mark = F.pmod(F.xxhash64(F.lit(4), "embedding"), F.lit(1 << 30))
    drawn = reps.where(mark < F.lit(min(1 << 30, math.ceil((1 << 30) * PROBES / n)))).select("id", "embedding").limit(2 * PROBES).toArrow()
    q, qid = _unit(drawn["embedding"], dims).astype(np.float32), drawn["id"].to_numpy()
    if not len(q):
        return len(cells.fine)
    asked = spark.sparkContext.broadcast((cells, q, qid))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, q, qid = asked.value
        cos = np.full((len(q), k), -np.inf, np.float32)
        held = np.full((len(q), k, MEMBER_OF), -1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _unit(b["embedding"], dims).astype(np.float32), b["id"].to_numpy()
            s = q @ x.T
            s[qid[:, None] == ids[None, :]] = -np.inf
            m = min(k, len(x))
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            met = np.unique(best)
            home = np.full((len(x), MEMBER_OF), -1, np.int64)
            home[met] = cells.nearest(x[met], MEMBER_OF)
            all_s, all_c = np.concatenate([cos, np.take_along_axis(s, best, 1)], 1), np.concatenate([held, home[best]], 1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
            cos, held = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_c, top[:, :, None], 1)
        ok = np.isfinite(cos)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(ok)[0].astype(np.int32)), pa.array(cos[ok]), pa.array(list(held[ok]), pa.list_(pa.int64()))], ["q", "cosine", "cells"])

    found = reps.select("id", "embedding").mapInArrow(near, "q int, cosine float, cells array<bigint>")
    best = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "cells")), asc=False), 1, k).alias("b"))
    true = [(r.q, b.cells) for r in best.collect() for b in r.b]
    who, home = np.array([w for w, _ in true], int), np.array([c for _, c in true], np.int64).reshape(-1, MEMBER_OF)
    asks = 2
    while asks < len(cells.fine):
        ask = cells.nearest(q, asks)[who]
        if (ask[:, :, None] == home[:, None, :]).any((1, 2)).mean() >= REACH:
            break
        asks = asks * 3 // 2 if asks & (asks - 1) == 0 else asks * 4 // 3
    return min(asks, len(cells.fine))


def _routed(reps: DataFrame, n: int, dims: int, k: int) -> tuple[DataFrame, int]:
    """(shard, role, id, embedding) and the number of shards: each vector once per shard that it asks, with role 0 where it is a member."""
    spark = reps.sparkSession
    wanted = min(MOST_CELLS, math.ceil(MEMBER_OF * n / CELL)) if n > CELL else 1
    cells = fit_cells(reps, n, dims, wanted) if wanted > 1 else None
    asks = cells_to_ask(reps, n, dims, cells, k) if cells else 1
    held = spark.sparkContext.broadcast((cells, asks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _assigned(held.value[0], _unit(b["embedding"], dims), MEMBER_OF)
                cell, k = np.unique(near[near >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(k)], ["cell", "n"])

    per_cell = reps.select("embedding").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    parts = np.ones(1 if cells is None else len(cells.fine), np.int64)
    for r in per_cell:
        parts[r.cell] = max(1, -(-r.n // (2 * CELL)))
    base = np.concatenate([[0], np.cumsum(parts)])
    dealt = spark.sparkContext.broadcast((parts, base))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, base = dealt.value
        for b in batches:
            if not b.num_rows:
                continue
            near = _assigned(held.value[0], _unit(b["embedding"], dims), held.value[1])
            own = b["own"].to_numpy()
            row, nth = np.nonzero(near >= 0)
            cell = near[row, nth]
            times = parts[cell]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, nth, cell = np.repeat(row, times), np.repeat(nth, times), np.repeat(cell, times)
            member = (nth < MEMBER_OF) & (part == own[row] % parts[cell])
            yield pa.RecordBatch.from_arrays(
                [pa.array((base[cell] + part).astype(np.int32)), pa.array((~member).astype(np.int32)), b["id"].take(pa.array(row)), b["embedding"].take(pa.array(row))], ["shard", "role", "id", "embedding"]
            )

    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("own")
    return reps.select("id", "embedding", own).mapInArrow(route, "shard int, role int, id bigint, embedding array<float>"), int(base[-1])


def nearest_vectors(reps: DataFrame, k: int, dims: int, beam: int = BEAM) -> DataFrame:
    """(id, found): up to ``k`` structs (cosine, other), best first, for each row (id, embedding) of ``reps``; ids must be unique."""
    routed, shards = _routed(reps, reps.count(), dims, k)
    rows = routed.repartitionById(max(shards, 1), F.col("shard")).sortWithinPartitions("shard", "role")
    found = rows.mapInArrow(_search(k, dims, beam), "id bigint, found array<struct<cosine: double, other: bigint>>")
    met = found.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("found")), asc=False).alias("met"))
    # a neighbour met in several cells has the same cosine there and is listed once
    once = F.filter("met", lambda f, i: (i == 0) | (f["other"] != F.get("met", i - 1)["other"]))
    return met.select("id", F.slice(once, 1, k).alias("found"))


def most_similar(vectors: DataFrame, k: int = 10, dims: int = 64, beam: int = BEAM) -> DataFrame:
    """(name, other, cosine): for each entity_name the up to ``k`` other names with the most similar embeddings.

    The embedding with the highest vec_id of a name counts; a name takes part if it is usable. Null names take no part.
    Of equally similar names any may be given. Names with equal vectors are each other's first neighbours; in a group of
    more than ``k`` copies each is linked to those next to it by name. No usable vector gives no rows.
    """
    work = Scratch(vectors.sparkSession)
    named = counted(vectors, ["entity_name"], "vec_id", ["embedding"]).where(usable(F.col("embedding"), dims))
    named = work.cut(named.select(F.col("entity_name").alias("name"), "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")))
    few = named.withColumn("_n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("name"))).where(F.col("_n") <= k)
    groups = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("name")).alias("names"), F.first("embedding").alias("embedding"))
    sizes = named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    reps = work.cut(groups.join(sizes, ["h1", "h2"]).withColumn("id", F.monotonically_increasing_id()))
    near = work.cut(nearest_vectors(reps.select("id", "embedding"), k, dims, beam))
    # from a group that leaves room beside its own copies to the names of the groups found
    small = reps.where(F.col("copies") <= k).select("id", "names")
    links = near.select("id", F.explode("found").alias("f")).select("id", F.col("f.cosine").alias("cosine"), F.col("f.other").alias("other"))
    told = links.join(reps.select(F.col("id").alias("other"), F.col("names").alias("theirs")), "other").groupBy("id").agg(F.collect_list(F.struct("cosine", "theirs")).alias("found"))
    own = F.transform("names", lambda a: F.struct(F.lit(-1.0).alias("far"), a.alias("name")))
    theirs = F.flatten(F.transform(F.coalesce("found", F.array()), lambda f: F.transform(f["theirs"], lambda b: F.struct((-f["cosine"]).alias("far"), b.alias("name")))))
    listed = small.join(told, "id", "left").select("names", own.alias("own"), F.sort_array(theirs).alias("theirs"))
    listed = listed.select(F.explode("names").alias("name"), F.concat("own", "theirs").alias("all"))
    best = F.slice(F.filter("all", lambda o: o["name"] != F.col("name")), 1, k)
    out = listed.select("name", F.explode(best).alias("o")).select("name", F.col("o.name").alias("other"), (-F.col("o.far")).alias("cosine"))
    # among the copies of a group that leaves no room
    large = reps.where(F.col("copies") > k).select(F.struct("h1", "h2").alias("h"), "copies")
    parts = spread_join(named.select("name", F.struct("h1", "h2").alias("h")), large, "h", large, "copies")
    parts = parts.withColumn("part", F.pmod(F.xxhash64("name"), F.floor(F.col("copies") / COPIES_PART) + 1))
    order = Window.partitionBy("h", "part").orderBy("name")
    beside = F.array(*[f("name", i).over(order) for i in range(1, k + 1) for f in (F.lag, F.lead)])
    copies = parts.select("name", beside.alias("beside")).select("name", F.explode(F.slice(F.filter("beside", lambda b: b.isNotNull()), 1, k)).alias("other"), F.lit(1.0).alias("cosine"))
    return out.unionByName(copies)


def similar_pairs(vectors: DataFrame, least: float = 0.97, k: int = 10, dims: int = 64) -> DataFrame:
    """(name_a, name_b): pairs of which one is among the other's ``k`` most similar and whose cosine is at least ``least``."""
    near = most_similar(vectors, k, dims).where(F.col("cosine") >= least)
    return near.select(F.least("name", "other").alias("name_a"), F.greatest("name", "other").alias("name_b")).distinct()
