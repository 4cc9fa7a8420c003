"""Findings of static reports, topology and history as one list of issues, and a health score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators.graph import Topology
from quarrygraph.operators.ranks import ranked

ISSUE = ["source", "severity", "category", "entity", "entity_type", "file"]
#: What an issue says beside these: how sure it is, what to do, and the figures behind it.
DETAIL = ["confidence", "suggestion", "metrics"]
# A share of the score each.
WEIGHTS = {"quality": 0.4, "maintainability": 0.3, "structure": 0.3}


def _issue(df: DataFrame, source: str, severity: object, category: str, entity: str, kind: object, file: str, suggestion: object = None, confidence: object = None, **metrics: str) -> DataFrame:
    lit = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    figures = F.create_map(*[c for k, v in metrics.items() for c in (F.lit(k), F.expr(v).cast("double"))]) if metrics else F.create_map().cast("map<string,double>")
    return df.select(
        F.lit(source).alias("source"), lit(severity).alias("severity"), F.lit(category).alias("category"), F.expr(entity).alias("entity"), lit(kind).alias("entity_type"), F.expr(file).alias("file"), lit(confidence).alias("confidence"), lit(suggestion).alias("suggestion"), figures.alias("metrics")
    )


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*ISSUE, *DETAIL[:2]]) + ", metrics map<string,double>")


def in_scope(path: str, scope: str):  # noqa: ANN201
    return (F.col(path) == scope) | F.col(path).startswith(scope.rstrip("/") + "/") if scope else F.lit(True)


def static_issues(report: DataFrame, scope: str = "") -> DataFrame:
    """Giant files, giant functions and test smells of reports (see ``sources.reports``); a file without a maintainability score has 5."""
    rows = lambda c: report.select(F.explode(c).alias("x")).select("x.*").where(in_scope("path", scope))
    base = "element_at(split(path, '/'), -1)"
    score = report.select(F.explode("maintainability_scores").alias("x")).groupBy(F.col("x.path").alias("path")).agg(F.max("x.score").alias("_s"))
    giant = rows("giant_files").join(score, "path", "left")
    files = _issue(giant, "static", F.when(F.col("severity") == "critical", "P0").otherwise("P1"), "god_class", base, "file", "path", "Consider splitting into multiple files", lines="lines", maintainability_score="coalesce(_s, 5.0)", total_score="0")
    funcs = _issue(rows("giant_functions"), "static", "P1", "god_function", "function_name", "function", "path", "Refactor into smaller functions", lines="lines", complexity="coalesce(complexity, 0)", total_score="0")
    smells = _issue(rows("test_smells"), "static", "P2", "test_smell", base, "file", "path", F.concat(F.lit("Fix "), F.col("type")), start_line="coalesce(line_number, 0)")
    return files.unionByName(funcs).unionByName(smells)


def maintainability(report: DataFrame, scope: str = "") -> DataFrame:
    """One row (maintainability): ten times the mean score, null without scores."""
    return report.select(F.explode("maintainability_scores").alias("x")).select("x.*").where(in_scope("path", scope)).agg((F.avg("score") * 10).alias("maintainability"))


def with_maintainability(issues: DataFrame, report: DataFrame) -> DataFrame:
    """Adds each file's maintainability score, 5.0 if there is none."""
    s = report.select(F.explode("maintainability_scores").alias("x")).groupBy(F.col("x.path").alias("file")).agg(F.max("x.score").alias("_s"))
    return issues.join(s, "file", "left").select(*issues.columns, F.coalesce("_s", F.lit(5.0)).alias("maintainability"))


def breakdown(report: DataFrame) -> DataFrame:
    """(file, file_size, comment_ratio, naming): a file report's issues counted by category."""
    i = report.select(F.explode("file_reports").alias("r")).select(F.col("r.file_path").alias("file"), F.explode("r.issues").alias("i"))
    c = F.col("i.category")
    return i.groupBy("file").agg(F.count_if(c.isin("super_large_file", "large_file", "medium_large_file")).alias("file_size"), F.count_if(c == "low_comment_ratio").alias("comment_ratio"), F.count_if(c == "naming_violation").alias("naming"))


def topology_issues(t: Topology) -> DataFrame:
    low = F.col("reason") == "neighbors_unresolved"
    why = F.when(low, "Its edges are unresolved: look at the resolved ratio before taking it for dead code").otherwise("Connect it to other entities or consider removing it if unused")
    intricate = X.is_intricate(F.col("entity"))
    split = F.when(intricate, "Parsers, generators and commands are intricate by nature: refactoring helps reading but is not urgent").otherwise("High fan-out: refactor into smaller functions")
    parts = [
        _issue(t.orphans(), "topology", F.when(low, "P2").otherwise("P1"), "orphan_entity", "entity", F.col("type"), "source_id", why, F.when(low, "low").otherwise("medium"), in_degree="0", out_degree="0"),
        _issue(t.hubs(), "topology", "P1", "hub_fragility", "entity", F.col("type"), "source_id", "High fan-in is fragile: consider splitting its responsibilities", in_degree="degree"),
        _issue(t.gods(), "topology", F.when(intricate, "P1").otherwise("P0"), "god_function", "entity", F.col("type"), "source_id", split, out_degree="degree", is_domain_complexity=f"CASE WHEN entity rlike '{X.intricate_pattern()}' THEN 1 ELSE 0 END"),
        _issue(t.placeholders(), "topology", "P2", "placeholder_module", "module", "module", "''", "So few entities suggest an unfinished module", entity_count="entities"),
        _issue(t.coupling().where("density > 0.5"), "topology", "P1", "coupling_density", "'cross-module'", "system", "''", F.format_string("Coupling density is %.2f: consider another architecture", "density"), density="density", cross_module_relations="cross_module", intra_module_relations="intra_module"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def git_issues(hot: DataFrame, silos: DataFrame) -> DataFrame:
    a = _issue(hot.where("score >= 80"), "git", "P0", "critical_hotspot", "file", "file", "file", "Changes often and much: test it well and consider splitting it", score="score", commits="commits", lines="lines")
    return a.unionByName(_issue(silos.where("risk = 'critical'"), "git", "P1", "knowledge_silo", "file", "file", "file", F.concat(F.lit("Only "), F.col("owner"), F.lit(" knows it: share the knowledge")), contributors="contributors", ownership="ownership", commits="commits"))


def git_score(hot: DataFrame, silos: DataFrame) -> DataFrame:
    """One row (git_score): 100 less 15 per critical hotspot and 8 per silo, at most 40 each."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("one", F.lit(1))
    both = one(hot.where("score >= 80"), "h").join(F.broadcast(one(silos.where("risk = 'critical'"), "s")), "one")
    return both.select((100 - F.least(F.col("h") * 15, F.lit(40)) - F.least(F.col("s") * 8, F.lit(40))).alias("git_score"))


def enriched(issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """Issues with what the history says of their files: the age of the last change settles the ``confidence`` of orphans,
    god functions in files that changed more than ten times are ``is_hotspot`` and become P0. Files without history keep
    what they have. The line numbers in ``file`` are not part of the path."""
    m = metrics.select(F.col("file").alias("_f"), "modified_days", F.col("commits").alias("_c"))
    j = issues.withColumn("_f", X.without_lines(F.col("file"))).join(m, "_f", "left")
    d = F.col("modified_days")
    aged = (F.col("category") == "orphan_entity") & d.isNotNull()
    conf = F.when(aged, F.when(d > 365, "high").when(d > 90, "medium").otherwise("low")).otherwise(F.col("confidence"))
    hot = F.coalesce((F.col("category") == "god_function") & (F.col("_c") > 10), F.lit(False))
    more = F.when(aged & (d > 365), " (unchanged for over a year)").when(aged & (d <= 90), " (changed lately, may be new)").when(hot, F.concat(F.lit(" (hotspot: "), F.col("_c"), F.lit(" changes)"))).otherwise("")
    figures = F.when(aged, F.map_concat("metrics", F.create_map(F.lit("last_modified_days"), d.cast("double")))).when(hot, F.map_concat("metrics", F.create_map(F.lit("change_frequency"), F.col("_c").cast("double")))).otherwise(F.col("metrics"))
    return j.select("source", F.when(hot, "P0").otherwise(F.col("severity")).alias("severity"), *ISSUE[2:], conf.alias("confidence"), F.concat("suggestion", more).alias("suggestion"), figures.alias("metrics"), hot.alias("is_hotspot"))


def numbered(issues: DataFrame) -> DataFrame:
    """Issues with ids 'debt-001' and so on by source, severity, category, entity and file."""
    return ranked(issues, ["source", "severity", "category", "entity", "file"], "_r").select(F.format_string("debt-%03d", F.col("_r")).alias("id"), *issues.columns)


def issue_counts(issues: DataFrame) -> DataFrame:
    """(source, severity, n)."""
    return issues.groupBy("source", "severity").agg(F.count(F.lit(1)).alias("n"))


def health(issues: DataFrame, topology_score: DataFrame, maintain: DataFrame | None = None, git: DataFrame | None = None) -> DataFrame:
    """One row (p0, p1, p2, quality, maintainability, structure, total, grade). Quality takes static issues only; a missing
    dimension gives its weight to the others; the git score, if there is one, stands for the structure."""
    n = lambda s, static: F.count_if((F.col("severity") == s) & ((F.col("source") == "static") if static else F.lit(True)))
    out = issues.agg(*[n(s, False).alias(s.lower()) for s in ("P0", "P1", "P2")], F.greatest(F.lit(0), 100 - n("P0", True) * 10 - n("P1", True) * 5 - n("P2", True)).cast("double").alias("quality")).withColumn("one", F.lit(1))
    structure = (git.select(F.col("git_score").alias("structure")) if git is not None else topology_score.select(F.col("score").alias("structure"))).withColumn("one", F.lit(1))
    out = out.join(F.broadcast(structure), "one").withColumn("structure", F.col("structure").cast("double"))
    out = out.join(F.broadcast(maintain.withColumn("one", F.lit(1))), "one") if maintain is not None else out.withColumn("maintainability", F.lit(None).cast("double"))
    have = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in WEIGHTS.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("total", (F.round(total / have, 9)).cast("int"))
    grade = F.when(F.col("total") >= 90, "A").when(F.col("total") >= 80, "B").when(F.col("total") >= 70, "C").when(F.col("total") >= 60, "D").otherwise("F")
    return out.select("p0", "p1", "p2", "quality", "maintainability", "structure", "total", grade.alias("grade"))
