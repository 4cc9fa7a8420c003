"""Modules, what depends on what, and an overview of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators.graph import edges_of, module_edges, named


def placed(entities: DataFrame) -> DataFrame:
    """Named entities with a source that are not external."""
    return named(entities).where(~X.is_external(F.col("entity_type"), F.col("source_id")) & (F.col("source_id") != ""))


def auto_depth(entities: DataFrame, depth: int = 2) -> int:
    """The least depth from ``depth`` on at which there is more than one module besides '.', else the greatest there is.

    All depths are counted in one pass over the distinct directories.
    """
    dirs = placed(entities).select(F.slice(X.path_parts(F.col("source_id")), 1, X.directories(F.col("source_id"))).alias("d")).distinct()
    row = dirs.agg(F.max(F.size("d"))).first()
    deepest = max(depth, (row[0] if row else 0) or 0)
    at = F.explode(F.sequence(F.lit(depth), F.lit(deepest))).alias("depth")
    kinds = dirs.where(F.size("d") > 0).select("d", at).groupBy("depth").agg(F.count_distinct(F.array_join(F.expr("slice(d, 1, depth)"), "/")).alias("n"))
    first = kinds.where("n > 1").agg(F.min("depth")).first()
    return first[0] if first and first[0] is not None else deepest


def dependencies(relations: DataFrame, entities: DataFrame, depth: int = 2, auto: bool = True) -> DataFrame:
    """(from_module, to_module, kind, n): edges between different modules, one row per kind."""
    d = auto_depth(entities, depth) if auto else depth
    pairs = module_edges(edges_of(relations), placed(entities), X.module_of(F.col("source_id"), d)).where("src_module <> tgt_module")
    return pairs.select(F.col("src_module").alias("from_module"), F.col("tgt_module").alias("to_module"), "kind", "n")


def modules(entities: DataFrame, depth: int = 2, auto: bool = True) -> DataFrame:
    d = auto_depth(entities, depth) if auto else depth
    return placed(entities).select(X.module_of(F.col("source_id"), d).alias("module")).distinct()


def touches(relations: DataFrame) -> DataFrame:
    """(entity, n): relation ends at each name; a relation to itself counts twice."""
    ends = relations.select(F.explode(F.array("src_id", "tgt_id")).alias("entity")).where("entity <> ''")
    return ends.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def overview_counts(entities: DataFrame, depth: int = 2) -> DataFrame:
    """(module, type, n): entities of each module by type."""
    return placed(entities).groupBy(X.module_of(F.col("source_id"), depth).alias("module"), F.coalesce("entity_type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def overview_files(entities: DataFrame, depth: int = 2) -> DataFrame:
    """(module, file): the distinct file names of each module."""
    return placed(entities).select(X.module_of(F.col("source_id"), depth).alias("module"), X.file_name(F.col("source_id")).alias("file")).distinct()


def overview_top(relations: DataFrame, entities: DataFrame, depth: int = 2, top: int = 10) -> DataFrame:
    """(module, rank, entity, n): the entities of each module with the most relation ends; ties by name."""
    e = placed(entities).select(F.col("entity_name").alias("entity"), X.module_of(F.col("source_id"), depth).alias("module"))
    n = e.join(touches(relations), "entity", "left").select("module", "entity", F.coalesce("n", F.lit(0)).alias("n"))
    order = Window.partitionBy("module").orderBy(F.desc("n"), "entity")
    return n.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).select("module", "rank", "entity", "n")


def type_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(tab, kind, n): entities by type and relations by kind."""
    e = entities.groupBy(X.text(F.col("entity_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("tab"), "kind", "n")
    return e.unionByName(relations.groupBy(X.text(F.col("keywords")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relations").alias("tab"), "kind", "n"))


def freshness(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(file, fresh): each distinct source path and whether it is in ``files`` (file)."""
    paths = entities.where("source_id <> '' AND source_id <> 'external'").select(X.without_line_range(F.col("source_id")).alias("file")).distinct()
    there = files.select("file", F.lit(True).alias("_there")).distinct()
    return paths.join(there, "file", "left").select("file", F.coalesce("_there", F.lit(False)).alias("fresh"))


def freshness_summary(fresh: DataFrame) -> DataFrame:
    """One row (total, valid, stale, ratio); ratio 1 if there is no path."""
    valid = F.count_if("fresh")
    return fresh.agg(F.count(F.lit(1)).alias("total"), valid.alias("valid"), F.count_if(~F.col("fresh")).alias("stale"), F.round(F.coalesce(valid / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)), 3).alias("ratio"))


# Languages by file extension.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "php": "php", "swift": "swift", "m": "objc", "go": "go", "rs": "rust", "rb": "ruby", "c": "c", "cpp": "cpp", "cs": "csharp", "kt": "kotlin"}
# Directories that hold code of others.
VENDORED = ["node_modules", "vendor", "venv", ".venv", "dist", "build", "target", "__pycache__", ".git"]


def languages(files: DataFrame) -> DataFrame:
    """(language, n): files of a listing (file) by language; vendored directories and unknown extensions are left out."""
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]
    own = ~F.exists(F.split("file", "/"), lambda p: p.isin(VENDORED))
    return files.where(own).select(lang.alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def uncovered_language(counts: DataFrame, covered: list[str], least: int = 10) -> str | None:
    """The most frequent language that is not covered, if it has at least ``least`` files and more than any covered one."""
    rows = {r.language: r.n for r in counts.collect()}
    most = max((n for k, n in rows.items() if k in covered), default=0)
    other = max(((n, k) for k, n in rows.items() if k not in covered), default=None)
    return other[1] if other and other[0] >= least and other[0] > most else None
