"""The line-delimited interchange format: meta, entity and edge records told apart by ``type``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.functions import exprs as X

# The format's required fields and known kinds.
REQUIRED = {"meta": ["schema_version", "generator"], "entity": ["id", "entity_type", "source_id", "provenance"], "edge": ["kind", "src", "resolution_qualifier", "source_id"]}
ENTITY_TYPES = "class constructor enum field function interface method namespace property record type_alias variable".split()
EDGE_KINDS = ["CALLS", "INHERITS", "IMPORTS", "REFERENCES"]
QUALIFIERS = ["resolved", "ambiguous", "unresolved"]
SUPPORTED_VERSION = 1
UNRESOLVED = "<unresolved>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(line, bad, seq, and the fields of all record types): one row per non-blank line; ``bad`` if it is not a JSON object.

    ``seq`` orders the lines: by file, the offset of the part of the file that a task reads, and the place in it. The
    latter grows with the line within a part, which is all that is needed to tell which of two lines comes later.
    """
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    return parse(spark.read.text(path).select(F.col("value").alias("line"), seq.alias("seq")))


def parse(lines: DataFrame) -> DataFrame:
    """The same of a frame (line) or (line, seq)."""
    names = [f.split()[0] for f in schema.NDJSON.split(", ")]
    rec = F.from_json("line", f"{schema.NDJSON}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"})
    seq = _seq(lines)
    rows = lines.where(F.trim("line") != "").select("line", *seq, rec.alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.select("line", *seq, bad.alias("bad"), *[F.col(f"r.{n}").alias(n) for n in names])


def _seq(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "seq"]


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """The parsable records alone."""
    return read(spark, path).where(~F.col("bad")).drop("bad")


def _complete(kind: str) -> Column:
    ok = F.col("type") == kind
    for c in REQUIRED[kind]:
        ok = ok & F.col(c).isNotNull()
    return ok


def entities(records: DataFrame) -> DataFrame:
    """Mapped entities of the complete entity records; unknown types are kept."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return records.where(~F.col("bad") & _complete("entity")).select(
        F.col("id").alias("entity_name"), "entity_type", F.concat_ws(" | ", some("signature"), some("description")).alias("description"), "source_id", X.text(F.col("signature")).alias("signature"), X.file_of(F.col("source_id")).alias("file_path"), F.coalesce("provenance", F.lit("ast")).alias("provenance"), "content_hash", *_seq(records)
    )


def _target() -> Column:
    q, raw = F.col("resolution_qualifier"), F.nullif(F.col("dst_raw"), F.lit(""))
    return F.when(q == "resolved", F.nullif(F.col("dst"), F.lit(""))).when(q == "ambiguous", raw).when(q == "unresolved", raw)


def relations(records: DataFrame) -> DataFrame:
    """Mapped relations of the complete edge records that have a target; ambiguous and unresolved ones point at the expression in the code, never at a candidate."""
    edges = records.where(~F.col("bad") & _complete("edge")).withColumn("tgt_id", _target()).where("tgt_id IS NOT NULL")
    return edges.select(
        F.col("src").alias("src_id"), "tgt_id", F.col("kind").alias("keywords"), F.concat(F.col("kind"), F.lit(" from "), F.col("src"), F.lit(" at "), F.col("source_id")).alias("description"), "source_id",
        F.when(F.col("resolution_qualifier") == "resolved", 1.0).otherwise(0.5).alias("weight"), "resolution_qualifier", F.nullif(F.col("dst_raw"), F.lit("")).alias("dst_raw"), F.when(F.size("candidates") > 0, F.col("candidates")).alias("candidates"), *_seq(records),
    )


def verdicts(records: DataFrame) -> DataFrame:
    """(verdict, type, n): what became of the records: 'stored', 'skipped' or 'dropped' (unresolved without an expression, not counted as skipped)."""
    silent = _complete("edge") & (F.col("resolution_qualifier") == "unresolved") & (X.text(F.col("dst_raw")) == "")
    stored = _complete("entity") | (_complete("edge") & _target().isNotNull()) | (F.col("type") == "meta")
    verdict = F.when(F.col("bad"), "skipped").when(F.coalesce(silent, F.lit(False)), "dropped").when(F.coalesce(stored, F.lit(False)), "stored").otherwise("skipped")
    return records.groupBy(verdict.alias("verdict"), X.text(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def warnings(records: DataFrame) -> DataFrame:
    """(warning, n): schema warnings of the whole file, each once with the number of records."""
    t = F.col("type")
    missing = lambda k: (t == k) & ~_complete(k)
    w = F.array(
        F.when(F.col("bad"), "bad JSON"),
        F.when(~F.col("bad") & ~F.coalesce(t.isin("meta", "entity", "edge"), F.lit(False)), "unknown record type"),
        F.when(missing("meta") | missing("entity") | missing("edge"), F.concat(t, F.lit(": missing required field"))),
        F.when((t == "meta") & (F.col("schema_version") > SUPPORTED_VERSION), "schema_version is newer than supported"),
        F.when((t == "meta") & F.col("provenance_completeness").isNull(), "meta: missing provenance_completeness"),
        F.when((t == "entity") & _complete("entity") & ~F.col("entity_type").isin(ENTITY_TYPES), "unknown entity_type"),
        F.when((t == "edge") & _complete("edge") & ~F.col("kind").isin(EDGE_KINDS), "unknown edge kind"),
        F.when((t == "edge") & _complete("edge") & ~F.col("resolution_qualifier").isin(QUALIFIERS), "unknown resolution_qualifier"),
    )
    told = records.select(F.explode(F.filter(w, lambda x: x.isNotNull())).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))
    none = records.agg(F.count_if(t == "meta").alias("n")).where("n = 0").select(F.lit("no meta record").alias("warning"), F.lit(1).cast("bigint").alias("n"))
    ents = entities(records).agg(F.count_if(X.is_test_source(F.col("source_id"))).alias("n"), F.count(F.lit(1)).alias("all")).where("n > 0.5 * all").select(F.lit("most entities come from test files").alias("warning"), "n")
    return told.unionByName(none).unionByName(ents)


def summary(records: DataFrame) -> DataFrame:
    """(what, value, n): entities by type, edges by kind and by qualifier, and how many of each come from tests."""
    e, r = entities(records), relations(records)
    part = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    e = e.withColumn("test", X.is_test_source(F.col("source_id")))
    r = r.withColumn("test", X.is_test_source(F.col("source_id")))
    parts = [part(e, "entity_type", "entity_type"), part(e, "entity_test", "test"), part(r, "edge_kind", "keywords"), part(r, "edge_qualifier", "resolution_qualifier"), part(r, "edge_test", "test")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def meta(records: DataFrame) -> DataFrame:
    """(schema_version, generator, provenance_completeness) of the last complete meta record; no row without one."""
    cols = ["schema_version", "generator", "provenance_completeness"]
    kept = records.where(~F.col("bad") & _complete("meta"))
    return kept.agg(F.max(F.struct(*_seq(records), *cols)).alias("m")).where("m IS NOT NULL").select(*[F.col(f"m.{c}").alias(c) for c in cols])


def test_ratios(records: DataFrame) -> DataFrame:
    """One row (entities, relations, entity_test_ratio, relation_test_ratio): shares that come from tests, four digits, 0 without any."""
    part = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.coalesce(F.round(F.count_if(X.is_test_source(F.col("source_id"))) / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)).alias(f"{name}_tests")).withColumn("one", F.lit(1))
    both = part(entities(records), "entities").join(F.broadcast(part(relations(records), "relations")), "one")
    return both.select("entities", "relations", F.col("entities_tests").alias("entity_test_ratio"), F.col("relations_tests").alias("relation_test_ratio"))


def is_safe(records: DataFrame) -> bool:
    """Whether the file has any entity: one without must not replace a graph."""
    return not entities(records).isEmpty()
