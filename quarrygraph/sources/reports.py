"""JSON documents: static analysis reports and metric snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schema


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file; absent arrays are empty."""
    return _complete(spark.read.schema(schema.REPORT).json(path, multiLine=True))


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one report per line."""
    return _complete(spark.read.schema(schema.REPORT).json(path))


def _complete(df: DataFrame) -> DataFrame:
    arrays = ["giant_files", "giant_functions", "test_smells", "maintainability_scores", "file_reports"]
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in arrays})


def read_snapshots(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Metric snapshots, one JSON document per line or, with ``whole_files``, per file; what does not parse or has no entity or time is passed over."""
    return spark.read.schema(schema.SNAPSHOTS).json(path, multiLine=whole_files, mode="DROPMALFORMED").where("entity IS NOT NULL AND timestamp IS NOT NULL")


def save_snapshots(snapshots: DataFrame, path: str) -> None:
    """Appends snapshots as JSON lines, split by entity slug; of one entity and second the last counts when they are read with ``dedupe_snapshots``."""
    snapshots.withColumn("slug", F.concat_ws("_", F.substring(F.regexp_replace("entity", "[^A-Za-z0-9]+", "_"), 1, 40), F.substring(F.md5("entity"), 1, 8))).write.mode("append").partitionBy("slug").json(path)


def prune_snapshots(spark: SparkSession, path: str, months: int = 12, now: Column | None = None) -> DataFrame:
    """Removes what is older than ``months`` of 30 days from a folder of ``save_snapshots``: the rest is written beside it and takes its place. Returns the rest."""
    kept = read_snapshots(spark, path).where(F.col("timestamp") >= (F.current_timestamp() if now is None else now) - F.make_interval(days=F.lit(30 * months)))
    fresh, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    save_snapshots(kept, fresh)
    jvm = spark.sparkContext._jvm
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(p(path), p(old))
    fs.rename(p(fresh), p(path))
    fs.delete(p(old), True)
    return read_snapshots(spark, path)


def slug(entity: str) -> str:
    """A file name for an entity: its letters and digits, and eight digits of its MD5."""
    import hashlib
    import re

    return f"{re.sub(r'[^A-Za-z0-9]+', '_', entity).strip('_')[:40]}_{hashlib.md5(entity.encode()).hexdigest()[:8]}"
