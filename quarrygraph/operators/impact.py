"""What a change touches: changed symbols, their callers, modules, tests and the risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import exprs as X
from quarrygraph.operators.traverse import reached
from quarrygraph.session import Scratch


def range_overlaps(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, name, line_start, line_end, lines_changed): spans that meet a range of the same ``key``, and the summed overlap.

    Ranges (key, s, e) are closed and may overlap one another; each counts. The join is on the key, the overlap a
    residual condition. Rows with a null key or bound match nothing.
    """
    hit = spans.join(ranges, key).where((F.col("line_start") <= F.col("e")) & (F.col("s") <= F.col("line_end")))
    lines = F.least("line_end", "e") - F.greatest("line_start", "s") + 1
    return hit.groupBy(key, "name", "line_start", "line_end").agg(F.sum(lines).alias("lines_changed"))


def changed_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, change, line_start, line_end, lines_changed) of ``files`` (path, change_type, added, deleted: arrays of (s, e)).

    All symbols of an added file, those that meet a changed range of a modified one, and one '<deleted:stem>' per deleted file.
    """
    f = files.withColumnRenamed("path", "file")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "")
    null = F.lit(0).cast("bigint")
    gone = f.where("change_type = 'DELETED'").select("file", F.concat(F.lit("<deleted:"), stem, F.lit(">")).alias("name"), F.lit("DELETED").alias("change"), null.alias("line_start"), null.alias("line_end"), null.alias("lines_changed"))
    new = symbols.join(f.where("change_type = 'ADDED'").select("file"), "file", "left_semi").select("file", "name", F.lit("ADDED").alias("change"), F.col("line_start").cast("bigint"), F.col("line_end").cast("bigint"), (F.col("line_end") - F.col("line_start") + 1).cast("bigint").alias("lines_changed"))
    ranges = f.where("change_type = 'MODIFIED'").select("file", F.explode(F.concat("added", "deleted")).alias("r")).select("file", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    met = range_overlaps(ranges, symbols, "file").select("file", "name", F.lit("MODIFIED").alias("change"), F.col("line_start").cast("bigint"), F.col("line_end").cast("bigint"), F.col("lines_changed").cast("bigint"))
    return gone.unionByName(new).unionByName(met)


def qualified(symbols: DataFrame) -> DataFrame:
    """Adds ``symbol``: the name behind the module of its Python file, unless it has it already."""
    module = X.python_module(F.col("file"))
    name = F.when((module == "") | F.col("name").startswith(F.concat(module, F.lit("."))), F.col("name")).otherwise(F.concat_ws(".", module, F.col("name")))
    return symbols.withColumn("symbol", name)


def callers(relations: DataFrame, symbols: DataFrame, depth: int = 2, full: bool = False) -> DataFrame:
    """(caller, file, line, distance): where ``symbols`` (symbol) are called from.

    File and line are those of the call itself, not of another call of the same caller; a caller is told apart by name
    and file, of several calls in one file the first line counts. Callers that were changed themselves are kept. For any
    ``depth`` above 1 callers of callers follow at distance 2; ``full`` goes on up to ``depth`` hops. Calls without a
    source have file '' and line 0.
    """
    work = Scratch(relations.sparkSession)
    file, line = X.file_and_line(F.col("source_id"))
    calls = work.cut(relations.where("keywords = 'CALLS' AND src_id <> '' AND tgt_id <> ''").select("tgt_id", F.col("src_id").alias("caller"), file.alias("file"), line.alias("line")))
    n = F.count(F.lit(1))
    front, told = work.told(symbols.select(F.col("symbol").alias("tgt_id")).where("tgt_id <> ''").distinct(), n=n)
    asked, found = front, None
    for d in range(1, (depth if full else min(depth, 2)) + 1):
        if not told["n"]:
            break
        hit = reached(calls, front, told["n"], "tgt_id").groupBy("caller", "file").agg(F.min("line").alias("line"))
        if found is not None:
            hit = hit.join(found.select("caller", "file"), ["caller", "file"], "left_anti")
        new = work.cut(hit.select("caller", "file", "line", F.lit(d).alias("distance")))
        found = new if found is None else found.unionByName(new)
        front, told = work.told(new.select(F.col("caller").alias("tgt_id")).distinct().join(asked, "tgt_id", "left_anti"), n=n)
        asked = asked.unionByName(front)
    return found if found is not None else calls.select("caller", "file", "line", F.lit(1).alias("distance")).limit(0)


def affected_modules(symbols: DataFrame, found: DataFrame) -> DataFrame:
    files = symbols.select("file").union(found.select("file"))
    return files.select(X.python_module(F.col("file")).alias("module")).where("module <> ''").distinct()


def affected_tests(found: DataFrame) -> DataFrame:
    return found.where(X.is_test_file(F.col("file"))).select("file").distinct()


def risk(symbols: DataFrame, found: DataFrame, ratio: float | None = None, low: int = 3, high: int = 10) -> DataFrame:
    """One row (symbols, callers, modules, core, level, reason, suggestions): level high, medium, low or, on a graph with few resolved edges, unknown."""
    one = lambda df, *a: df.agg(*a).withColumn("one", F.lit(1))
    n = F.count(F.lit(1))
    out = one(symbols, n.alias("symbols"), F.coalesce(F.bool_or(X.is_core_module(F.col("file"))), F.lit(False)).alias("core"), F.min(F.when(X.is_core_module(F.col("file")), X.core_module(F.col("file")))).alias("core_name"))
    tests = affected_tests(found)
    first = tests.orderBy("file").limit(3).agg(F.array_sort(F.collect_list("file")).alias("first_tests")).withColumn("one", F.lit(1))
    parts = [one(found, n.alias("callers"), F.count_if(F.col("distance") == 1).alias("direct")), one(affected_modules(symbols, found), n.alias("modules")), one(tests, n.alias("tests")), first]
    for p in parts:
        out = out.join(F.broadcast(p), "one")
    c, m, r = F.col("callers"), F.col("modules"), F.lit(ratio).cast("double")
    level = F.when(F.col("core") | (c >= high) | (m >= 5), "high").when(c >= low, "medium").when(r < 0.1, "unknown").when((r < 0.5) & (c == 0), "medium").otherwise("low")
    percent = F.format_string("%.1f%%", r * 100)
    causes = F.array(F.when(F.col("core"), F.concat(F.lit("changes to core module ("), "core_name", F.lit(")"))), F.when(c >= high, F.concat(c, F.lit(" callers affected"))), F.when(m >= 5, F.concat(m, F.lit(" modules impacted"))))
    reason = (
        F.when(F.col("level") == "high", F.concat(F.lit("High risk: "), F.array_join(causes, ", ")))
        .when(c >= low, F.concat(F.lit("Medium risk: "), c, F.lit(" callers, "), m, F.lit(" modules affected")))
        .when(F.col("level") == "unknown", F.concat(F.lit("Impact unknown: only "), percent, F.lit(" of the edges are resolved; "), c, F.lit(" caller(s) found say little about the reach")))
        .when(F.col("level") == "medium", F.concat(F.lit("Medium risk: no callers found, but only "), percent, F.lit(" of the edges are resolved; calls through factories may be missing")))
        .when(c == 0, "Low risk: no callers found, isolated change")
        .otherwise(F.concat(F.lit("Low risk: only "), c, F.lit(" caller(s), limited blast radius")))
    )
    more = F.when(F.col("tests") > 3, F.concat(F.lit(" (+"), F.col("tests") - 3, F.lit(" more)"))).otherwise("")
    is_level = lambda x: F.col("level") == x
    advice = F.array(
        F.when(F.col("tests") > 0, F.concat(F.lit("Run affected tests: "), F.array_join("first_tests", ", "), more)).otherwise("Run unit tests for changed modules"),
        F.when(is_level("high"), "Consider code review before merging"),
        F.when(is_level("high"), "Run full integration test suite"),
        F.when(is_level("high") & (F.col("direct") > 5), "Verify backward compatibility"),
        F.when(is_level("medium"), "Review direct callers for breaking changes"),
        F.when(is_level("medium") & (c > F.col("direct")), "Check indirect callers for side effects"),
        F.when(~F.col("level").isin("high", "medium") & (F.col("tests") == 0), "Consider adding tests for changed code"),
    )
    told = out.withColumn("level", level)
    return told.select("symbols", "callers", "modules", "core", "level", reason.alias("reason"), F.array_join(F.filter(advice, lambda x: x.isNotNull()), "; ").alias("suggestions"))


def caller_risk(found: DataFrame, low: int = 3, high: int = 10) -> DataFrame:
    """One row (callers, level, reason, suggestions) from the callers of one symbol alone."""
    c = F.col("callers")
    pick = lambda a, b, z: F.when(c >= high, a).when(c >= low, b).otherwise(z)
    reason = pick(F.concat(F.lit("Symbol has "), c, F.lit(" callers, changes may have widespread impact")), F.concat(F.lit("Symbol has "), c, F.lit(" callers")), F.concat(F.lit("Symbol has "), c, F.lit(" caller(s), limited blast radius")))
    advice = pick(F.lit("Review all caller sites before merging; Consider adding deprecation period; Run full test suite"), F.lit("Review affected callers; Run tests for affected modules"), F.lit("Run unit tests for changed code"))
    return found.agg(F.count(F.lit(1)).alias("callers")).select("callers", pick(F.lit("high"), F.lit("medium"), F.lit("low")).alias("level"), reason.alias("reason"), advice.alias("suggestions"))
