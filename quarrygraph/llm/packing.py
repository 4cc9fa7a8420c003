"""Filling containers of fixed capacity with texts of varying length (problem 8).

Large-item matching: of the texts above a third of the capacity at most two fit into one container, so they are paired
greedily, each with the longest that still fits beside it; the shorter texts then go, longest first, into the container
with the smallest gap that takes them. Texts are dealt by hash into packs of about ITEMS_PER_PACK, each filled by one
task; only the last containers of a pack are not full.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.bpe import count_tokens

ITEMS_PER_PACK = 20_000
VARIANT_BITS = 56


def fill(sizes: list[int], capacity: int) -> list[int]:
    """The container number (0, 1, ...) of each item, none above ``capacity``. Items of size 0 join container 0."""
    third = capacity / 3
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    large = [i for i in order if sizes[i] > third]
    place, gaps, used = [0] * len(sizes), [], 0
    waiting = [(sizes[i], i) for i in large]
    while waiting:
        size, i = waiting.pop()
        place[i], gap = used, capacity - size
        k = bisect_right(waiting, (gap, len(sizes)))
        if k:
            size, j = waiting.pop(k - 1)
            place[j] = used
            gap -= size
        if gap:
            gaps.append((gap, used))
        used += 1
    gaps.sort()
    for i in reversed(order[: len(order) - len(large)]):
        size = sizes[i]
        if size == 0:
            used = max(used, 1)
            continue
        k = bisect_left(gaps, (size, -1))
        if k < len(gaps):
            gap, b = gaps.pop(k)
        else:
            gap, b, used = capacity, used, used + 1
        place[i] = b
        if gap > size:
            insort(gaps, (gap - size, b))
    return place


def kinds(container_kinds: DataFrame) -> list[tuple[str, int, str]]:
    """The rows of ``container_kinds``, a fixed table: more than 100 are refused. Kinds without a positive capacity or a tokenizer are no containers."""
    rows = container_kinds.select("container_kind", F.col("capacity_tokens").cast("int"), "tokenizer").where("capacity_tokens > 0 AND container_kind IS NOT NULL AND tokenizer IS NOT NULL").distinct().limit(101).collect()
    if len(rows) > 100:
        raise ValueError("container_kinds must be a short list")
    return sorted((r[0], r[1], r[2]) for r in rows)


def pack(sizes: DataFrame, capacities: dict[str, int], packs: int) -> DataFrame:
    """(container_kind, container, doc_id, piece, tokens): each text placed once in every kind of container.

    ``sizes`` has one row (doc_id, tokens) per text, and may have the hash ``h`` of the text and a number ``row`` of those
    without doc_id. Texts are dealt by all of these, so neither many texts under one doc_id nor many equal texts without
    one meet in one pack. A text longer than the capacity is cut into full pieces, each a
    container of its own, and a rest that is packed like a text; no other text is cut. Empty texts share a container.
    Containers are numbered within their kind; all pieces of one container have the same number.
    """
    kind = dict(sizes.dtypes)["doc_id"]
    if not capacities:
        return sizes.sparkSession.createDataFrame([], f"container_kind string, container bigint, doc_id {kind}, piece int, tokens int")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in sorted(capacities.items())]))
    dealt = F.xxhash64("doc_id", *[c for c in ("h", "row") if c in sizes.columns])
    # pandas would turn a column of numbers with nulls into floats
    number = F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id")
    items = sizes.select(number, F.col("doc_id").isNull().alias("nameless"), F.pmod(dealt, F.lit(packs)).alias("pack"), F.col("tokens").cast("bigint").alias("tokens"), each.alias("k")).select("doc_id", "nameless", "pack", "tokens", "k.container_kind", "k.capacity")
    schema = f"container_kind string, container bigint, doc_id {kind}, nameless boolean, piece int, tokens int"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name, pack_no = key[0], int(key[1])
        rows = rows.sort_values(["nameless", "doc_id", "tokens"])
        unnamed = rows["nameless"].to_list()
        docs, tokens, capacity = rows["doc_id"].to_list(), rows["tokens"].to_list(), int(rows["capacity"].iloc[0])
        rests, whole = [], []
        for i, t in enumerate(tokens):
            full = (t - 1) // capacity if t > capacity else 0
            whole += [(i, p) for p in range(full)]
            rests.append((full, int(t - full * capacity)))
        place = fill([s for _, s in rests], capacity)
        used = max(place, default=-1) + 1
        base = pack_no << 32
        out = [(name, base + used + n, docs[i], unnamed[i], p, capacity) for n, (i, p) in enumerate(whole)]
        out += [(name, base + b, docs[i], unnamed[i], p, s) for i, (b, (p, s)) in enumerate(zip(place, rests, strict=True))]
        return pd.DataFrame(out, columns=["container_kind", "container", "doc_id", "nameless", "piece", "tokens"])

    placed = items.groupBy("container_kind", "pack").applyInPandas(one, schema)
    return placed.select("container_kind", "container", F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "piece", "tokens")


def pack_documents(documents: DataFrame, container_kinds: DataFrame, tokenizers: str = "/opt/tokenizers", nameless: bool = False) -> DataFrame:
    """``pack`` of the whole texts of ``documents`` in the tokens of each kind's tokenizer.

    A null or empty text has no tokens and is placed too. Rows with the same doc_id and text are one text. Rows without
    doc_id are left out, or with ``nameless`` each placed under a null doc_id. A kind of several capacities or tokenizers
    is filled for each; the container numbers of its n-th (by capacity, from 0) begin at n << VARIANT_BITS. No kinds or no
    documents give no rows.
    """
    packs = max(1, -(-documents.count() // ITEMS_PER_PACK))
    key = F.struct("doc_id", F.xxhash64("text").alias("h"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row"))
    runs: dict[tuple[str, int], dict[str, int]] = {}
    seen: dict[str, int] = {}
    for k, c, t in kinds(container_kinds):
        n = seen[k] = seen.get(k, -1) + 1
        runs.setdefault((t, n), {})[k] = c
    out = None
    for (name, n), capacities in sorted(runs.items()):
        counts = count_tokens(documents.select(key.alias("doc_id"), "text"), f"{tokenizers}/{name}.json").select("doc_id.*", "tokens")
        kept = counts if nameless else counts.where("doc_id IS NOT NULL")
        texts = kept.groupBy("doc_id", "h", "row").agg(F.max("tokens").alias("tokens"))
        part = pack(texts, capacities, packs).withColumn("container", F.col("container") + F.lit(n << VARIANT_BITS))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else pack(documents.select("doc_id", F.lit(0).alias("tokens")), {}, packs)


def capacities_of(found: list[tuple[str, int, str]]) -> dict[str, list[int]]:
    """The capacities of each of ``kinds``, in the order in which its containers are numbered."""
    out: dict[str, list[int]] = {}
    for k, c, _ in found:
        out.setdefault(k, []).append(c)
    return out


def filling(placed: DataFrame, capacities: dict[str, int] | dict[str, list[int]]) -> DataFrame:
    """(container_kind, texts, containers, tokens, spare_share) of the result of ``pack``."""
    each = [(k, n, c) for k, cs in capacities.items() for n, c in enumerate(cs if isinstance(cs, list) else [cs])]
    cap = F.coalesce(*[F.when((F.col("container_kind") == k) & (F.shiftright("container", VARIANT_BITS) == n), c) for k, n, c in each], F.lit(0))
    bins = placed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"), F.sum((F.col("piece") == 0).cast("int")).alias("texts"))
    return bins.groupBy("container_kind").agg(F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.round(1 - F.sum("tokens") / F.sum(cap), 6).alias("spare_share"))
