"""Commit logs and unified diffs as text: lines take over what the last header line before them says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The lines of a commit log with file figures and of a unified diff.
HEADER = r"^([0-9a-fA-F]{4,64})\|([^|]*)\|(\d+)\|(.*)$"
STAT = r"^(\d+|-)\s+(\d+|-)\s+(.+)$"
SECTION = r"^diff --git a/(.+) b/(.+)$"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of the text files at ``path``, each file's lines numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return numbered(whole)


def numbered(texts: DataFrame) -> DataFrame:
    """(file, pos, line) of a frame (file, value)."""
    return texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def _with_header(rows: DataFrame, is_header: Column) -> DataFrame:
    """Adds ``no``: the number of header lines up to each line of its file; lines before the first are dropped."""
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("no", F.sum(is_header.cast("int")).over(order)).where("no > 0")


def commits(rows: DataFrame) -> DataFrame:
    """(sha, author, ts, message, files) of log lines 'sha|author|epoch|subject' and 'added deleted path' below.

    '-' counts as 0; other lines are passed over. A header needs a hexadecimal id and four parts, so a path with '|'
    is none. A commit without files is kept with an empty list.
    """
    line = F.trim(F.col("line"))
    h = _with_header(rows.withColumn("line", line), line.rlike(HEADER))
    g = lambda i: F.regexp_extract("line", HEADER, i)
    head = F.col("line").rlike(HEADER)
    n = lambda i: F.when(F.regexp_extract("line", STAT, 1).eqNullSafe("-") | F.regexp_extract("line", STAT, 2).eqNullSafe("-"), 0).otherwise(F.regexp_extract("line", STAT, i).try_cast("bigint"))
    stat = F.when(~head & F.col("line").rlike(STAT), F.struct("pos", F.struct(F.regexp_extract("line", STAT, 3).alias("path"), n(1).alias("added"), n(2).alias("deleted")).alias("f")))
    first = F.max(F.when(head, F.struct(g(1).alias("sha"), g(2).alias("author"), g(3).cast("bigint").alias("ts"), g(4).alias("message"))))
    out = h.groupBy("file", "no").agg(first.alias("h"), F.array_sort(F.collect_list(stat)).alias("s"))
    return out.select("h.sha", "h.author", "h.ts", "h.message", F.transform("s", lambda x: x["f"]).alias("files"))


def changed_files(rows: DataFrame) -> DataFrame:
    """(path, change_type, added, deleted) of a unified diff: ranges (s, e) of new and old lines; ranges of no lines vanish."""
    h = _with_header(rows, F.col("line").rlike(SECTION))
    path = F.regexp_extract("line", SECTION, 2)
    num = lambda i: F.coalesce(F.regexp_extract("line", HUNK, i).try_cast("bigint"), F.lit(1))
    hunk = F.col("line").rlike(HUNK)
    span = lambda a, b: F.when(hunk & (num(b) > 0), F.struct("pos", num(a).alias("s"), (num(a) + num(b) - 1).alias("e")))
    flag = lambda p: F.bool_or(F.col("line").startswith(p))
    out = h.groupBy("file", "no").agg(
        F.max(F.when(F.col("line").rlike(SECTION), path)).alias("path"), flag("new file mode").alias("new"), flag("deleted file mode").alias("gone"), F.array_sort(F.collect_list(span(3, 4))).alias("a"), F.array_sort(F.collect_list(span(1, 2))).alias("d")
    )
    cut = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    none = F.filter(cut("a"), lambda x: F.lit(False))
    kind = F.when(F.col("gone"), "DELETED").when(F.col("new"), "ADDED").otherwise("MODIFIED")
    return out.select("path", kind.alias("change_type"), F.when(F.col("gone"), none).otherwise(cut("a")).alias("added"), F.when(F.col("new"), none).otherwise(cut("d")).alias("deleted"))


def listing(rows: DataFrame, extensions: list[str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(file) distinct paths of a name list or of 'XY path' and 'XY old -> new' status lines, of the given extensions and, if given, among ``existing`` (file)."""
    line = F.col("line")
    path = F.when(line.rlike(r"^[ MADRCU?!]{2} "), F.regexp_replace(F.substring(line, 4, 1 << 30), r"^.* -> ", "")).otherwise(F.trim(line))
    found = rows.select(F.regexp_replace(path, '^"|"$', "").alias("file")).where("file <> ''").distinct()
    if existing is not None:
        found = found.join(existing.select("file").distinct(), "file", "left_semi")
    return found if not extensions else found.where(F.regexp_extract("file", r"(\.[^./]+)$", 1).isin(extensions))


def warning_lines(rows: DataFrame) -> DataFrame:
    """(warning) of an extractor's output: its 'WARNING:' lines, and one line per language whose parser is missing."""
    line = F.trim("line")
    lang = F.regexp_extract(line, r"(?i)parser library not installed.*?(\w+)\W*$", 1)
    told = F.when(line.startswith("WARNING:"), line).when(lang != "", F.concat(F.lit("parser missing: "), F.lower(lang)))
    return rows.select(told.alias("warning")).where("warning IS NOT NULL").distinct()


def is_partial(warning: str) -> bool:
    """Whether a warning means that symbols are missing from the graph; others only tell of its quality."""
    return "Parser library not installed" in warning or warning.startswith("language fingerprint:")


def silenced(warnings: list[str], silence: list[str]) -> list[str]:
    """The warnings that contain none of the texts of ``silence``, whatever the case; blank texts silence nothing."""
    texts = [s.lower() for s in silence if s.strip()]
    return [w for w in warnings if not any(s in w.lower() for s in texts)]
