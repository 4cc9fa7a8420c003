"""Finding entities by name and by vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.functions.names import matching_ratio, ratio_bound
from quarrygraph.operators.graph import named
from quarrygraph.operators.ranks import ranked
from quarrygraph.session import Scratch

LEAST_SCORE = 0.4
FUZZY = 0.7


def of_type(entities: DataFrame, kind: str | None) -> DataFrame:
    return named(entities) if not kind else named(entities).where(F.lower(X.text(F.col("entity_type"))) == kind.lower())


def _shown(df: DataFrame, score: Column) -> DataFrame:
    return df.select(F.col("entity_name").alias("entity"), F.col("entity_type").alias("type"), "source_id", F.substring(X.text(F.col("description")), 1, 200).alias("description"), score.alias("score"))


def find_exact(entities: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Names that equal the query (1.0) or contain it (0.9), whatever the case."""
    name, q = F.lower("entity_name"), query.lower()
    return _shown(of_type(entities, kind).where(name.contains(q)), F.when(name == q, 1.0).otherwise(0.9))


def find_fuzzy(entities: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Other names by the ratio of the name or 0.7 of the description's, from 0.4 on; what cannot reach it by length never meets Python."""
    q = F.lit(query.lower())
    name, text = F.lower("entity_name"), F.when(F.col("description") != "", F.lower("description"))
    rest = of_type(entities, kind).where(~name.contains(query.lower()))
    may_name, may_text = ratio_bound(q, name) >= LEAST_SCORE, text.isNotNull() & (ratio_bound(q, text) * 0.7 >= LEAST_SCORE)
    rest = rest.where(may_name | may_text)
    scored = rest.withColumn("_a", matching_ratio(q, F.when(may_name, name))).withColumn("_b", matching_ratio(q, F.when(may_text, text)))
    return _shown(scored.where(F.greatest("_a", F.col("_b") * 0.7) >= LEAST_SCORE), F.greatest("_a", F.col("_b") * 0.7))


def find(entities: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The best ``limit`` of both, by score, then name."""
    both = find_exact(entities, query, kind).unionByName(find_fuzzy(entities, query, kind))
    return both.orderBy(F.desc("score"), "entity").limit(limit).withColumn("score", F.bround("score", 3))


def similar(workspaces: dict[str, tuple[DataFrame, DataFrame]], name: str) -> DataFrame:
    """(workspace, entity, match_type, relations) of the same name ('exact') or one with a ratio above 0.7 ('fuzzy') in
    each workspace (entities, relations); a relation of an entity to itself counts once."""
    out = None
    q = F.lit(name.lower())
    for ws, (ents, rels) in sorted(workspaces.items()):
        low = F.lower("entity_name")
        exact = named(ents).where(F.col("entity_name") == name).select("entity_name", F.lit("exact").alias("match_type"))
        near = named(ents).where((F.col("entity_name") != name) & (ratio_bound(q, low) > FUZZY)).select("entity_name", matching_ratio(q, low).alias("_r")).where(F.col("_r") > FUZZY).select("entity_name", F.lit("fuzzy").alias("match_type"))
        found = exact.unionByName(near)
        ends = rels.select(F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("entity_name")).join(found.select("entity_name"), "entity_name", "left_semi").groupBy("entity_name").agg(F.count(F.lit(1)).alias("n"))
        part = found.join(ends, "entity_name", "left").select(F.lit(ws).alias("workspace"), F.col("entity_name").alias("entity"), "match_type", F.coalesce("n", F.lit(0)).alias("relations"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no workspace")
    return out


# vectors


def l2_distance(v: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(v, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, query: list[float], k: int = 10, prefix: str = "", key: str = "entity_name") -> DataFrame:
    """The ``k`` rows nearest to ``query`` by L2, ties by key, with ``distance``: exact, filtered before the limit, one bounded heap per task.

    Vectors of another length than the query are passed over; an empty query raises.
    """
    if not query:
        raise ValueError("empty query vector")
    rows = vectors.where(F.size("embedding") == len(query))
    if prefix:
        rows = rows.where(F.col("source_id").startswith(prefix))
    return rows.withColumn("distance", l2_distance(F.col("embedding"), query)).orderBy("distance", key).limit(k).drop("embedding")


def knn_many(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", block: int = 2000) -> DataFrame:
    """(query, other, distance): the ``k`` rows of ``vectors`` (key, embedding) nearest to each of ``queries`` by L2, exact, ties by key.

    The queries are taken in blocks of at most ``block``, each broadcast to a scan of all vectors in which a task keeps the
    best ``k`` per query; only these are shuffled. Queries and vectors of different lengths do not meet; null keys and
    vectors with nulls take no part.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    whole = F.col(key).isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    asked = Scratch(spark).cut(ranked(queries.where(whole).select(F.col(key).cast("bigint").alias("q"), F.col("embedding").cast("array<double>").alias("embedding")), ["q"]))
    n = asked.count()
    rows = vectors.where(whole).select(F.col(key).cast("bigint").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = None
    for lo in range(0, max(n, 1), block):
        part = asked.where((F.col("rank") > lo) & (F.col("rank") <= lo + block)).toPandas()
        held = spark.sparkContext.broadcast({size: (g["q"].to_numpy(), np.array(g["embedding"].tolist())) for size, g in part.groupby(part["embedding"].map(len))})

        def near(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                sizes = np.array([len(v) for v in b["embedding"]], int)
                for size, (q, x) in held.value.items():
                    at = np.flatnonzero(sizes == size)
                    if not len(at) or not size:
                        continue
                    keys, v = b["key"].to_numpy()[at], b["embedding"].take(pa.array(at)).flatten().to_numpy().reshape(-1, size)
                    for c in range(0, len(v), 4096):
                        d = ((x**2).sum(1)[:, None] + (v[c : c + 4096] ** 2).sum(1)[None, :] - 2 * x @ v[c : c + 4096].T).clip(0)
                        d0, k0 = best.get(size, (np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)))
                        d, ks = np.concatenate([d0, d], 1), np.concatenate([k0, np.broadcast_to(keys[c : c + 4096], (len(q), len(keys[c : c + 4096])))], 1)
                        # some more than k are kept, as the fast form of the distance is not exact to the last digit
                        top = np.argpartition(d, min(2 * k, d.shape[1]) - 1, axis=1)[:, : 2 * k]
                        best[size] = np.take_along_axis(d, top, 1), np.take_along_axis(ks, top, 1)
            for size, (_, ks) in best.items():
                q, x = held.value[size]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, ks.shape[1])), pa.array(ks.ravel())], ["query", "other"])

        met = rows.mapInArrow(near, "query bigint, other bigint")
        out = met if out is None else out.unionByName(met)
    met = out.distinct().join(asked.select(F.col("q").alias("query"), F.col("embedding").alias("_a")), "query").join(rows.select(F.col("key").alias("other"), F.col("embedding").alias("_b")), "other")
    exact = F.sqrt(F.aggregate(F.zip_with("_a", "_b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    found = met.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct(exact.alias("distance"), "other"))), 1, k).alias("f"))
    return found.select("query", F.explode("f").alias("f")).select("query", "f.other", "f.distance")


def as_score(distance: Column) -> Column:
    """Distance of unit vectors as a similarity from 0 to 1, three digits."""
    return F.bround(F.greatest(F.lit(0.0), 1 - distance * distance / 2), 3)


def search(vectors: DataFrame, entities: DataFrame, query: list[float], kind: str | None = None, limit: int = 20) -> DataFrame:
    """(entity, type, source_id, description, score): the nearest vectors' names with what the entities say of them; a type filter applies before the limit."""
    info = named(entities).select("entity_name", "entity_type", "description")
    rows = vectors if not kind else vectors.join(of_type(entities, kind).select("entity_name"), "entity_name", "left_semi")
    near = knn(rows, query, limit)
    return near.join(info, "entity_name", "left").orderBy("distance", "entity_name").select(F.col("entity_name").alias("entity"), X.text(F.col("entity_type")).alias("type"), "source_id", F.substring(X.text(F.col("description")), 1, 200).alias("description"), as_score(F.col("distance")).alias("score"))


def normalised(v: Column) -> Column:
    """v / ‖v‖; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


Embedder = Callable[[list[str]], list[list[float]]]


def hash_embedder(dims: int = 768) -> Embedder:
    """A deterministic embedder without a model: numbers from -1 to 1 from repeated SHA-256 of the text."""

    def embed(texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for t in texts:
            data, i = b"", 0
            while len(data) < 2 * dims:
                data += hashlib.sha256(f"{i}:{t}".encode()).digest()
                i += 1
            out.append([int.from_bytes(data[2 * j : 2 * j + 2], "big") / 32767.5 - 1 for j in range(dims)])
        return out

    return embed


def embed_entities(entities: DataFrame, embed: Embedder, batch: int = 32, known: DataFrame | None = None) -> DataFrame:
    """(entity_name, source_id, embedding) of entities with a description and no vector in ``known``, in batches of ``batch``; vectors of length zero are dropped."""
    todo = named(entities).where("description <> ''").select("entity_name", "source_id", "description")
    if known is not None:
        todo = todo.join(known.select("entity_name"), "entity_name", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, vecs = f["description"].tolist(), []
            for lo in range(0, len(texts), batch):
                vecs += embed(texts[lo : lo + batch])
            yield pd.DataFrame({"entity_name": f["entity_name"], "source_id": f["source_id"], "embedding": vecs})

    out = todo.select("entity_name", "source_id", "description").mapInPandas(run, "entity_name string, source_id string, embedding array<float>")
    return out.where(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0)


def check_provider(recorded: str | None, wanted: str, vectors: int) -> None:
    """Vectors of one provider must not be searched with another's queries."""
    if vectors and recorded is None:
        raise ValueError("vectors exist but their provider is not recorded")
    if vectors and recorded != wanted:
        raise ValueError(f"vectors come from {recorded}, not {wanted}")
