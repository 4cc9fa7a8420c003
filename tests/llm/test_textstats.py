import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import rules, textstats


@pytest.fixture
def common(spark):
    return spark.createDataFrame([("en", "the"), ("en", "And"), ("zh", "的"), ("zh", "我们"), (None, None), ("en", " ")], "lang string, word string")


def stats(spark, common, texts):
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").withColumn("words", F.lit("clash")).withColumn("_t", F.lit("clash"))
    return {r.doc_id: r for r in textstats.text_statistics(df, common).collect()}


def test_statistics(spark, common):
    got = stats(spark, common, ["The cat, and THE dog.\n\nno end", "我们的 map!", None, "", " \n\t", "word " * 40_000, "a\r\nb.\rc"])
    a = got[0]
    assert (a.words, a.lines) == (7, 2)
    assert a.common_share == pytest.approx(3 / 7) and a.ended_share == 0.5
    assert a.mean_word_length == pytest.approx(20 / 7) and a.symbol_share == pytest.approx(2 / 22)
    assert got[1].words == 4 and got[1].common_share == pytest.approx(3 / 4) and got[1].ended_share == 1
    for i in (2, 3, 4):
        assert set(got[i][1:]) == {0.0}
    assert got[5].words == 40_000 and got[5].mean_word_length == 4
    assert got[6].lines == 3 and got[6].ended_share == pytest.approx(1 / 3)


def test_statistics_without_common_words_or_rows(spark, common):
    df = spark.createDataFrame([(1, "the")], "doc_id bigint, text string")
    assert textstats.text_statistics(df, common.limit(0)).first().common_share == 0
    assert textstats.text_statistics(df.limit(0), common).count() == 0


def test_majority(spark):
    rows = [(1, "List"), (1, " list "), (1, "junk"), (2, "list"), (2, "junk"), (3, None), (4, "odd"), (None, "list"), (5, "PROSE"), (5, "PROSE")]
    assert sorted(map(tuple, textstats.majority_labels(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, shape string, rater string")).collect())) == [(1, "list"), (5, "prose")]


def test_rules_on_held_out():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = np.where(x[:, 0] > 0.8, "junk", np.where((x[:, 1] < 0.3) & (x[:, 2] > 0.5), "list", "prose")).astype(object)
    noisy = y.copy()
    noisy[rng.random(4000) < 0.05] = "table"
    r = rules.induce(x[:2000], noisy[:2000].astype(str), list("abcde"), ["junk", "table", "list"], "prose")
    assert (r.predict(x[2000:]) == y[2000:]).mean() > 0.96


def test_case_equals_predict(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 3))
    y = np.where(x[:, 0] > 0.5, "junk", "prose")
    r = rules.induce(x, y, ["a", "b", "c"], ["junk", "list"], "prose")
    got = spark.createDataFrame(x.tolist(), "a double, b double, c double").select("a", "b", "c", F.expr(r.case()).alias("s")).collect()
    assert [g.s for g in got] == r.predict(np.array([g[:3] for g in got])).tolist() and r.rules
    none = rules.induce(np.empty((0, 3)), np.empty(0, str), ["a", "b", "c"], ["junk"], "prose")
    assert none.case() == "'prose'" and none.predict(x).tolist() == ["prose"] * 300


def test_shapes_end_to_end(spark, common):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    make = {
        "prose": lambda: " ".join(f"The {word()} and the {word()} were {word()}, {word()} {word()} the {word()}." for _ in range(6)),
        "list": lambda: "\n".join(f"- {word()} {word()}" for _ in range(12)),
        "table": lambda: "\n".join(f"{word()}\t{r.randrange(99)}\t{r.randrange(99)}" for _ in range(12)),
        "junk": lambda: "".join(r.choice("{}<>;=$#@!%&0123456789") for _ in range(200)),
    }
    names = [n for n in ["prose", "prose", "prose", "list", "table", "junk"] * 60]
    docs = spark.createDataFrame([(i, make[n]()) for i, n in enumerate(names)] + [(9001, None), (9002, ""), (9003, "  ")], "doc_id bigint, text string").withColumn("shape", F.lit("clash"))
    labels = spark.createDataFrame([(i, n.upper(), "x") for i, n in enumerate(names) if i < 240], "doc_id bigint, shape string, rater string")
    got = {x.doc_id: x.shape for x in textstats.shapes(docs, labels, common).collect()}
    assert got.keys() == set(range(len(names)))
    assert sum(got[i] == n for i, n in enumerate(names) if i >= 240) >= 114
    assert {x.shape for x in textstats.shapes(docs, labels.limit(0), common).collect()} == {"prose"}
    assert textstats.shapes(docs.limit(0), labels, common).count() == 0
