"""The queries of problems 6 to 9 and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import bpe, neighbours, packing, textstats
from quarrygraph.plans.registry import Query, shipped
from quarrygraph.session import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[name] = shipped(f)
        if sql:
            SQL[name] = sql
        return f

    return add


_USABLE = """u AS (SELECT entity_name AS name, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT * FROM vec_node_descriptions WHERE entity_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY vec_id DESC) = 1)
  WHERE len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
 near AS (SELECT a.name AS a, b.name AS b, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.name <> b.name QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.name) <= 10)"""


@query("p6_found", f"WITH {_USABLE} SELECT DISTINCT least(a, b) AS name_a, greatest(a, b) AS name_b FROM near WHERE c >= 0.97")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vec_node_descriptions"))


@query("p6_neighbours")
def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(table(spark, d, "vec_node_descriptions"))


@query("p6_nearest", f"WITH {_USABLE} SELECT a AS name, count(*) AS found, round(max(c), 6) AS nearest FROM near GROUP BY a")
def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """How many neighbours each name has got and how near the nearest is."""
    found = neighbours.most_similar(table(spark, d, "vec_node_descriptions"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("found"), F.round(F.max("cosine"), 6).alias("nearest"))


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


@query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "container_kinds"), nameless=True)


@query(
    "p8_placed",
    "WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL) SELECT container_kind, (SELECT count(*) FROM t) AS texts, (SELECT count(*) FROM t WHERE coalesce(text, '') = '') AS without_tokens, 0::BIGINT AS over_capacity, 0::BIGINT AS placed_twice, 0::BIGINT AS cut_below_capacity, true AS well_filled FROM (SELECT DISTINCT container_kind FROM container_kinds)",
)
def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers of the texts with a doc_id: all placed, once, none above its capacity, none cut that would fit whole, little room left over."""
    kinds = table(spark, d, "container_kinds")
    placed = packing.pack_documents(table(spark, d, "documents"), kinds).join(F.broadcast(kinds.select("container_kind", F.col("capacity_tokens").alias("cap"))), "container_kind")
    texts = placed.groupBy("container_kind", "doc_id", "cap").agg(F.count_if(F.col("piece") == 0).alias("n"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    bins = placed.groupBy("container_kind", "container", "cap").agg(F.sum("tokens").alias("tokens")).groupBy("container_kind").agg(F.count_if(F.col("tokens") > F.col("cap")).alias("over_capacity"), (F.sum("tokens") >= 0.9 * F.sum("cap")).alias("well_filled"))
    told = texts.groupBy("container_kind").agg(F.sum("n").alias("texts"), F.count_if(F.col("tokens") == 0).alias("without_tokens"), F.count_if((F.col("n") == 1) & (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("cap"))))).alias("placed_twice"), F.count_if((F.col("n") == 1) & (F.col("pieces") > 1) & (F.col("tokens") <= F.col("cap"))).alias("cut_below_capacity"))
    return told.join(bins, "container_kind").select("container_kind", "texts", "without_tokens", "over_capacity", "placed_twice", "cut_below_capacity", "well_filled")


@query("p8_filling")
def p8_filling(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "container_kinds")
    return packing.filling(packing.pack_documents(table(spark, d, "documents"), kinds, nameless=True), packing.capacities_of(packing.kinds(kinds)))


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "common_words")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return textstats.shapes(*_texts(spark, d)).where(F.col("shape") != textstats.OTHER)


@query(
    "p9_statistics",
    r"""WITH c AS (SELECT list(DISTINCT lower(word)) FILTER (WHERE NOT regexp_matches(word, '[\x{4e00}-\x{9fff}]')) AS spaced,
  string_agg(DISTINCT lower(word), '|' ORDER BY len(lower(word)) DESC, lower(word)) FILTER (WHERE regexp_matches(word, '[\x{4e00}-\x{9fff}]')) AS han_words FROM common_words),
 t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents),
 w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{M}\p{N}''’]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS ls,
  len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) AS han, len(regexp_extract_all(t, '\p{L}|\p{M}')) AS let, len(regexp_extract_all(t, '\p{N}')) AS dig,
  len(regexp_replace(t, '[ \t\n\x{0b}\f\r]+', '', 'g')) AS seen,
  len(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{M}\p{N}''’]+'), lambda x: list_contains(c.spaced, x))) AS common,
  len(t) - len(regexp_replace(t, c.han_words, '', 'g')) AS covered FROM t, c),
 n AS (SELECT *, len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[\x{4e00}-\x{9fff}]'))) + han AS words FROM w)
 SELECT doc_id, words::DOUBLE AS words, coalesce((let + dig) / nullif(words, 0), 0) AS mean_word_length, coalesce((seen - let - dig) / nullif(seen, 0), 0) AS symbol_share,
  coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?。!?…]["”’»)\]'']*\s*$'))) / nullif(len(ls), 0), 0) AS ended_share, coalesce((common + covered) / nullif(words, 0), 0) AS common_share FROM n""",
)
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs, _, common = _texts(spark, d)
    return textstats.text_statistics(docs, common).select("doc_id", "words", "mean_word_length", "symbol_share", "ended_share", "common_share")
