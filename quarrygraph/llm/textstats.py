"""Per-document text statistics and the shape of a document (problem 9).

The statistics that are asked for are native SQL expressions over the whole text. The shape comes from an ordered list of
rules over general figures of the text (``charstats``), induced from labelled documents (``rules``) and applied as one
native CASE expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm import charstats
from quarrygraph.llm.rules import RuleList, induce
from quarrygraph.session import Scratch

#: At most this many labelled documents are used to induce the rules, chosen by a hash of doc_id.
MOST_LABELLED = 20_000
SHAPES = ["junk", "table", "list"]
OTHER = "prose"
LABELS = [*SHAPES, OTHER]
#: A character that is not white space, in Unicode's sense.
SEEN = r"(?U)\S"

#: How a line that ends in punctuation ends.
ENDED = r"[.!?。!?…][\"'”’»)\]]*\s*$"


def common_list(common_words: DataFrame) -> tuple[list[str], list[str]]:
    """The frequent words, in lower case, that are set apart by spaces, and those written in Han characters. The table is fixed and small: more than 10,000 words are refused."""
    words = [r[0] for r in common_words.select(F.lower("word")).where("word IS NOT NULL AND trim(word) <> ''").distinct().limit(10_001).collect()]
    if len(words) > 10_000:
        raise ValueError("common_words must be a short list")
    han = [w for w in words if any("\u4e00" <= c <= "\u9fff" for c in w)]
    return sorted(set(words) - set(han)), sorted(han, key=lambda w: (-len(w), w))


def _per(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b > 0, b), F.lit(0.0)).cast("double")


def _chars(text: Column, others: str) -> Column:
    """How many characters are left without runs of ``others``; far cheaper than counting them one by one."""
    return F.length(F.regexp_replace(text, others, "")).cast("double")


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, longest first, that looks at a character's first letters before it tries them."""
    first = "".join(sorted({re.escape(w[0]) for w in words}))
    long, single = [re.escape(w) for w in words if len(w) > 1], "".join(re.escape(w) for w in words if len(w) == 1)
    return f"(?=[{first}])(?:{'|'.join([*long, *([f'[{single}]'] if single else [])])})"


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_share, ended_share, common_share, lines), one row per row of ``documents``;
    a null, empty or blank text has zeros throughout.

    A word is a run of letters and digits, or one Han character. ``symbol_share`` is of the characters that are not
    white space, ``ended_share`` of the non-blank lines, ``common_share`` of the words (Han words by the characters
    they cover), whatever ``lang`` says. All native expressions over the whole text.
    """
    spaced, han = common_list(common_words)
    base = documents.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n").alias("_t"))
    t = F.col("_t")
    line = F.filter(F.split(t, "\n"), lambda x: x.rlike(SEEN))
    tokens = F.filter(F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}'’]+"), lambda x: x != "")
    base = base.select("*", line.alias("_l"), tokens.alias("_w"), _chars(t, r"[^\u4e00-\u9fff]+").alias("_han"), F.length(F.regexp_replace(t, r"\s+", "")).cast("double").alias("_seen"), _chars(t, r"[^\p{L}\p{M}]+").alias("_let"), _chars(t, r"[^\p{N}]+").alias("_dig"))
    hanless = F.filter("_w", lambda x: ~x.rlike("^[\u4e00-\u9fff]"))
    base = base.select("*", (F.size(hanless).cast("double") + F.col("_han")).alias("words"), F.size("_l").cast("double").alias("lines"))
    common = F.size(F.filter("_w", lambda x: x.isin(spaced))).cast("double") if spaced else F.lit(0.0)
    covered = (F.length(t) - F.length(F.regexp_replace(t, _any_of(han), ""))).cast("double") if han else F.lit(0.0)
    ended = F.size(F.filter("_l", lambda x: x.rlike(ENDED))).cast("double")
    known = F.col("_let") + F.col("_dig")
    return base.select(
        "doc_id", "words", _per(known, F.col("words")).alias("mean_word_length"), _per(F.col("_seen") - known, F.col("_seen")).alias("symbol_share"), _per(ended, F.col("lines")).alias("ended_share"), _per(common + covered, F.col("words")).alias("common_share"), "lines"
    )


def majority_labels(doc_labels: DataFrame) -> DataFrame:
    """(doc_id, shape): the shape that most raters gave, in lower case and trimmed; documents whose raters are split and null or unknown shapes are left out."""
    shape = F.lower(F.trim("shape"))
    votes = doc_labels.select("doc_id", shape.alias("shape")).where(F.col("shape").isin([*SHAPES, OTHER]) & F.col("doc_id").isNotNull()).groupBy("doc_id", "shape").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("doc_id").agg(F.max("n").alias("top"), F.max(F.struct("n", "shape")).alias("b"), F.collect_list("n").alias("all"))
    return best.where(F.size(F.filter("all", lambda x: x == F.col("top"))) == 1).select("doc_id", F.col("b.shape").alias("shape"))


@dataclass
class Learned:
    """What tells the shapes apart: the rules, the line model that some of their figures come from, and the common words."""

    rules: RuleList
    model: tuple[np.ndarray, np.ndarray]
    common: charstats.Common

    def wanted(self) -> list[str]:
        return sorted({self.rules.names[j] for r in self.rules.rules for j, _, _ in r.conditions})


def _figures(common: charstats.Common, names: list[str], pick):  # noqa: ANN001, ANN202
    """For mapInArrow over (doc_id, text, rest ...): the figures ``names`` of each row, by the model that ``pick`` gives for its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            for lo, hi in charstats.chunks(texts):
                rows = b.slice(lo, hi - lo)
                for model, at in pick(rows):
                    part = [texts[lo + i] for i in at]
                    found = charstats.features(part, common, model, LABELS, frozenset(names))
                    keep = rows.take(pa.array(at)).drop_columns(["text"])
                    yield pa.RecordBatch.from_arrays([*keep.columns, *[pa.array(found[k].astype(float)) for k in names]], [*keep.schema.names, *names])

    return run


def learn_shapes(documents: DataFrame, doc_labels: DataFrame, common_words: DataFrame, most: int = MOST_LABELLED) -> Learned:
    """Learns from at most ``most`` labelled documents with non-blank text. Without usable labels every document is prose.

    The line model is counted in two halves of these documents, and each half gets its figures for the rules from the
    other half's model, so that no document is scored by what it has added itself.
    """
    spark = documents.sparkSession
    common = charstats.Common(*common_list(common_words))
    chosen = majority_labels(doc_labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").rlike(SEEN))
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2)).cast("int").alias("half")
    rows = Scratch(spark).cut(rows.select("doc_id", "text", "shape", half))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [charstats.LineModel(LABELS) for _ in range(2)]
        for b in batches:
            texts, halves = b["text"].to_pylist(), b["half"].to_numpy()
            label = np.array([LABELS.index(x) for x in b["shape"].to_pylist()], int)
            for lo, hi in charstats.chunks(texts):
                for h in range(2):
                    at = lo + np.flatnonzero(halves[lo:hi] == h)
                    if len(at):
                        models[h].add(charstats.batch([texts[i] for i in at]), label[at])
        for h, m in enumerate(models):
            flat = np.concatenate([m.runs.ravel(), m.letters.ravel()]) - 1
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h, np.int32)), pa.array(at.astype(np.int32)), pa.array(flat[at].astype(np.int64))], ["half", "at", "n"])

    # one row per half and bucket: bounded, whatever the texts
    counted = rows.mapInArrow(count, "half int, at int, n bigint").groupBy("half", "at").agg(F.sum("n").alias("n")).toPandas()
    halves = []
    for h in range(2):
        m, part = charstats.LineModel(LABELS), counted[counted["half"] == h]
        flat = np.zeros(m.runs.size + m.letters.size)
        flat[part["at"].to_numpy(int)] = part["n"].to_numpy(float)
        m.runs += flat[: m.runs.size].reshape(m.runs.shape)
        m.letters += flat[m.runs.size :].reshape(m.letters.shape)
        halves.append(m)
    both = charstats.LineModel(LABELS)
    both.runs, both.letters = halves[0].runs + halves[1].runs - 1, halves[0].letters + halves[1].letters - 1
    held = spark.sparkContext.broadcast([m.ready() for m in halves])
    names = list(charstats.features([], common, both.ready(), LABELS))

    def other(b: pa.RecordBatch):  # noqa: ANN202
        h = b["half"].to_numpy()
        return [(held.value[1 - k], np.flatnonzero(h == k)) for k in range(2) if (h == k).any()]

    schema = "doc_id bigint, shape string, half int, " + ", ".join(f"{n} double" for n in names)
    stats = rows.mapInArrow(_figures(common, names, other), schema).toPandas().sort_values("doc_id", kind="stable")
    return Learned(induce(stats[names].to_numpy(float), stats["shape"].to_numpy(str), names, SHAPES, OTHER), both.ready(), common)


def shapes(documents: DataFrame, doc_labels: DataFrame, common_words: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, shape) of every row with non-blank text: prose, list, table or junk."""
    learned = learn_shapes(documents, doc_labels, common_words, most)
    rows = documents.where(F.col("text").rlike(SEEN))
    names = learned.wanted()
    if not names:
        return rows.select("doc_id", F.expr(learned.rules.case()).alias("shape"))
    model = documents.sparkSession.sparkContext.broadcast(learned.model)
    whole = lambda b: [(model.value, np.arange(b.num_rows))]
    stats = rows.select("doc_id", "text").mapInArrow(_figures(learned.common, names, whole), ", ".join([f"doc_id {dict(documents.dtypes)['doc_id']}", *[f"{n} double" for n in names]]))
    return stats.select("doc_id", F.expr(learned.rules.case()).alias("shape"))
