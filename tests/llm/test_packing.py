import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import packing


@pytest.mark.parametrize("seed", range(6))
def test_fill(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 3, 10, 100, 512])
    sizes = [min(capacity, int(r.expovariate(3 / capacity))) for _ in range(r.randrange(0, 400))]
    place = packing.fill(sizes, capacity)
    load = Counter()
    for b, s in zip(place, sizes, strict=True):
        load[b] += s
    assert all(v <= capacity for v in load.values()) and len(place) == len(sizes)
    if sizes:
        assert sorted(set(place)) == list(range(max(place) + 1))
        # no two containers could be one
        assert sum(1 for v in load.values() if 2 * v <= capacity) <= 1 or sum(sizes) == 0


def test_large_items_pair():
    assert len(set(packing.fill([60, 60, 40, 40], 100))) == 2
    assert len(set(packing.fill([34, 34, 34], 100))) == 2
    assert packing.fill([], 5) == [] and packing.fill([0, 0], 5) == [0, 0]


@pytest.fixture
def kinds(spark):
    return spark.createDataFrame([("s", 8, "byte_bpe_50k"), ("l", 64, "byte_bpe_50k"), ("bad", 0, "byte_bpe_50k"), (None, 5, "byte_bpe_50k"), ("s", 8, "byte_bpe_50k")], "container_kind string, capacity_tokens int, tokenizer string")


def test_documents(spark, kinds):
    texts = [None, "", " ", "one", "one two three", "word " * 50, "x", "same text", "same text"] + ["some words here " * i for i in range(1, 12)]
    docs = spark.createDataFrame([*enumerate(texts), (4, "one two three"), (None, "nameless")], "doc_id bigint, text string").withColumn("container", F.lit(1)).withColumn("capacity", F.lit(1)).withColumn("pack", F.lit(0))
    placed = packing.pack_documents(docs, kinds)
    rows = placed.collect()
    from quarrygraph.llm.bpe import count_tokens

    tokens = {r.doc_id: r.tokens for r in count_tokens(docs).where("doc_id IS NOT NULL").collect()}
    for kind, capacity in (("s", 8), ("l", 64)):
        own = [r for r in rows if r.container_kind == kind]
        per_doc, load = Counter(), Counter()
        for r in own:
            per_doc[r.doc_id] += r.tokens
            load[r.container] += r.tokens
        assert {k: per_doc[k] for k in per_doc} == tokens
        assert max(load.values()) <= capacity
        pieces = Counter(r.doc_id for r in own)
        assert all(n == max(1, -(-tokens[d] // capacity)) for d, n in pieces.items())
    assert {r.container_kind for r in rows} == {"s", "l"}
    fill = {r.container_kind: r for r in packing.filling(placed, {"s": 8, "l": 64}).collect()}
    assert fill["l"].texts == len(tokens) and fill["l"].tokens == sum(tokens.values()) and 0 <= fill["l"].spare_share < 1


def test_empty_tables(spark, kinds):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(docs, kinds).count() == 0
    assert packing.pack_documents(spark.createDataFrame([(1, "x")], docs.schema), kinds.limit(0)).count() == 0


def test_many_packs_keep_every_text(spark):
    sizes = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 17).alias("tokens"))
    placed = packing.pack(sizes, {"k": 16}, 7)
    assert placed.select("doc_id").distinct().count() == placed.count() == 500
    assert placed.groupBy("container").agg(F.sum("tokens").alias("t")).where("t > 16").count() == 0


def test_every_text_in_every_capacity(spark):
    kinds = spark.createDataFrame([("k", 4, "byte_bpe_50k"), ("k", 64, "byte_bpe_50k")], "container_kind string, capacity_tokens int, tokenizer string")
    big = 2**60 + 1
    rows = [(big, "one two three"), (big, "one"), (big, "one"), (None, "one two"), (None, "one two"), (7, None)]
    placed = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), kinds, nameless=True)
    texts = Counter(r.doc_id for r in placed.collect() if r.piece == 0)
    assert texts == {big: 4, None: 4, 7: 2}
    found = packing.filling(placed, packing.capacities_of(packing.kinds(kinds))).first()
    load = {r.container: r.t for r in placed.groupBy("container").agg(F.sum("tokens").alias("t")).collect()}
    small = {c: t for c, t in load.items() if c < 1 << packing.VARIANT_BITS}
    large = {c: t for c, t in load.items() if c not in small}
    assert len(large) == 1 and max(small.values()) <= 4 and sum(small.values()) == sum(large.values())
    assert found.texts == 10 and found.spare_share == pytest.approx(1 - sum(load.values()) / (4 * len(small) + 64), abs=1e-6)


def test_many_texts_of_one_key_are_spread(spark, kinds):
    sizes = spark.range(6000).select(F.lit(7).cast("bigint").alias("doc_id"), F.xxhash64("id").alias("h"), F.lit(None).cast("bigint").alias("row"), F.lit(3).alias("tokens"))
    same = spark.range(6000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("h"), F.col("id").alias("row"), F.lit(3).alias("tokens"))
    for df in (sizes, same):
        placed = packing.pack(df, {"s": 8}, 8)
        per = [r["count"] for r in placed.groupBy(F.shiftright("container", 32).alias("pack")).count().collect()]
        assert len(per) == 8 and sum(per) == 6000 and max(per) < 1200
