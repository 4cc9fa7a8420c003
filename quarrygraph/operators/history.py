"""Figures from commit logs and metric snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators.ranks import ranked

RISKS = ["critical", "high", "medium", "informational"]


def file_metrics(commits: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per file of ``commits`` (sha, author, ts as epoch seconds, message, files array of (path, added, deleted)).

    Commits are counted per file and author first, so a file that is in most commits costs its reducer one row per
    author. ``author_list`` is sorted. The primary author has most commits; ties go to the least name. A null author is 'unknown'.
    """
    now = F.unix_timestamp(F.current_timestamp()) if now is None else now
    rows = commits.select(F.coalesce("author", F.lit("unknown")).alias("author"), "ts", X.is_bug_fix(F.col("message")).cast("int").alias("fix"), F.explode("files").alias("f")).where("f.path IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = rows.groupBy(F.col("f.path").alias("file"), "author").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fix").alias("fixes"), F.sum(zero("f.added")).alias("added"), F.sum(zero("f.deleted")).alias("deleted"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    most = F.min(F.struct((-F.col("n")).alias("n"), "author"))
    m = per.groupBy("file").agg(
        F.sum("n").alias("commits"), F.count(F.lit(1)).alias("authors"), F.array_sort(F.collect_list("author")).alias("author_list"), most["author"].alias("primary_author"), F.sum("fixes").alias("bug_fixes"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"), F.min("first").alias("created"), F.max("last").alias("modified")
    )
    days = lambda c: F.floor((now - F.col(c)) / 86400).cast("bigint")
    return m.select(
        "file", "commits", "authors", "author_list", "primary_author", "bug_fixes", (F.col("bug_fixes") / F.col("commits")).alias("bug_fix_ratio"), "lines_added", "lines_deleted", (F.col("lines_added") + F.col("lines_deleted")).alias("churn"), days("modified").alias("modified_days"), days("created").alias("age_days")
    )


def scored(metrics: DataFrame, least: int = 20) -> DataFrame:
    """(file, commits, lines, score): files that change often and much; generated files are left out."""
    raw = F.col("commits") * F.log10(F.col("churn") + 1) * 10
    score = F.when((F.col("commits") > 0) & (F.col("churn") > 0), F.least(F.lit(100), raw.cast("int"))).otherwise(0)
    lines = F.greatest(F.lit(100), F.floor(F.col("churn") / 2)).cast("bigint")
    return metrics.where(~X.is_generated_file(F.col("file"))).select("file", "commits", lines.alias("lines"), score.alias("score")).where(F.col("score") >= least)


def hotspots(metrics: DataFrame, least: int = 20) -> DataFrame:
    """(rank, file, commits, lines, score) of ``scored`` files, the highest scores first, ties by name."""
    return ranked(scored(metrics, least), [F.desc("score"), F.asc("file")]).select("rank", "file", "commits", "lines", "score")


def bus_factor(metrics: DataFrame, commits: DataFrame) -> DataFrame:
    """(file, owner, contributors, ownership, commits, risk): files of one author ('critical') or two ('high'); in a
    repository of a single author, whose names differ in case or space only, all are 'informational'."""
    alone = commits.agg(F.count_distinct(F.lower(F.trim(F.coalesce("author", F.lit("unknown"))))).alias("n")).select((F.col("n") == 1).alias("alone"), F.lit(1).alias("one"))
    few = metrics.where("authors <= 2").withColumn("one", F.lit(1)).join(F.broadcast(alone), "one")
    risk = F.when(F.col("alone"), "informational").when(F.col("authors") == 1, "critical").otherwise("high")
    return few.select("file", F.col("primary_author").alias("owner"), F.col("authors").alias("contributors"), F.when(F.col("authors") == 1, 1.0).otherwise(0.75).alias("ownership"), "commits", risk.alias("risk"))


def by_risk(found: DataFrame) -> DataFrame:
    """Ordered by risk, then most commits, then name."""
    return found.orderBy(risk_order(), F.desc("commits"), "file")


def risk_order() -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk"))


def git_summary(metrics: DataFrame, hot: DataFrame, silos: DataFrame) -> DataFrame:
    """One row (files, commits, hotspots, critical_hotspots, critical_silos)."""
    one = lambda df, *a: df.agg(*a).withColumn("one", F.lit(1))
    out = one(metrics, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("commits"), F.lit(0)).alias("changes"))
    for p in (one(hot, F.count(F.lit(1)).alias("hotspots"), F.count_if(F.col("score") >= 80).alias("critical_hotspots")), one(silos, F.count_if(F.col("risk") == "critical").alias("critical_silos"))):
        out = out.join(F.broadcast(p), "one")
    return out.drop("one")


def metric_points(snapshots: DataFrame, months: int | None = 6, workspace: str | None = None, now: Column | None = None) -> DataFrame:
    """(entity, entity_type, metric, ts, value) of snapshots (entity, entity_type, timestamp, metrics map, workspace) of the last ``months`` of 30 days."""
    now = F.current_timestamp() if now is None else now
    kept = snapshots.where("timestamp IS NOT NULL AND metrics IS NOT NULL")
    if months is not None:
        kept = kept.where(F.col("timestamp") >= now - F.make_interval(days=F.lit(30 * months)))
    if workspace is not None:
        kept = kept.where(F.col("workspace") == workspace)
    return kept.select("entity", "entity_type", F.col("timestamp").alias("ts"), F.explode("metrics").alias("metric", "value")).where("value IS NOT NULL")


def trends(points: DataFrame, least: int = 3) -> DataFrame:
    """(entity, metric, points, slope, intercept, r2, direction, forecast, alert): least squares per entity and metric over
    whole days since its first point; the forecast is for 30 days after the last. A series on one day has slope 0, a
    constant one r2 0; series of fewer than ``least`` points give no row."""
    sec = F.col("ts").cast("timestamp").cast("double")
    ends = points.groupBy("entity", "metric").agg(F.count(F.lit(1)).alias("points"), F.min(sec).alias("t0"), F.max(sec).alias("t1")).where(F.col("points") >= least)
    x = points.select("entity", "metric", F.col("value").cast("double").alias("y"), sec.alias("t")).join(ends, ["entity", "metric"])
    day = lambda t: F.floor((t - F.col("t0")) / 86400)
    x = x.withColumn("x", day(F.col("t")).cast("double"))
    fit = x.groupBy("entity", "metric", "points", "t0", "t1").agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.regr_r2("y", "x").alias("r"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    fit = fit.select("entity", "metric", "points", F.coalesce("s", F.lit(0.0)).alias("slope"), F.when(F.col("s").isNull(), F.col("m")).otherwise(F.col("i")).alias("intercept"), F.when(F.col("v") == 0, 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r2"), (day(F.col("t1") + 30 * 86400)).cast("double").alias("next"))
    direction = F.when(F.col("slope") > 0.1, "increasing").when(F.col("slope") < -0.1, "decreasing").otherwise("stable")
    return fit.select("entity", "metric", "points", "slope", "intercept", "r2", direction.alias("direction"), (F.col("slope") * F.col("next") + F.col("intercept")).alias("forecast"), (F.col("slope") > 0.15).alias("alert"))


def dedupe_snapshots(snapshots: DataFrame) -> DataFrame:
    """One snapshot per entity and second: the last in time counts. ``metrics`` is carried as sorted entries, as maps cannot be compared."""
    cols = [c for c in snapshots.columns if c not in ("entity", "metrics", "timestamp")]
    packed = F.struct("timestamp", F.array_sort(F.map_entries("metrics")).alias("m"), *cols)
    best = snapshots.groupBy("entity", F.date_trunc("second", F.col("timestamp")).alias("_second")).agg(F.max(packed).alias("r"))
    row = {c: F.col(f"r.{c}") for c in ["timestamp", *cols]} | {"entity": F.col("entity"), "metrics": F.map_from_entries("r.m")}
    return best.select(*[row[c].alias(c) for c in snapshots.columns])


def recent(snapshots: DataFrame, months: int = 12, now: Column | None = None) -> DataFrame:
    """Retention: what is not older than ``months`` of 30 days."""
    return snapshots.where(F.col("timestamp") >= (F.current_timestamp() if now is None else now) - F.make_interval(days=F.lit(30 * months)))
