"""Continuous ingestion: interchange files dropped into a folder are upserted into a workspace, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrygraph.functions import exprs as X
from quarrygraph.operators.store import Workspace
from quarrygraph.sources import ndjson


def ingest_stream(spark: SparkSession, folder: str, workspace: Workspace, checkpoint: str, incremental: bool = False) -> StreamingQuery:
    """Starts a query that stores each new file of ``folder`` once. A batch that is run again gives the same state, as
    upserts are idempotent. With ``incremental`` symbols that vanished from a batch's files are deleted."""
    lines = spark.readStream.text(folder).select(F.col("value").alias("line"))

    def store(batch: DataFrame, _id: int) -> None:
        records = ndjson.parse(batch).persist()
        try:
            ents, rels = ndjson.entities(records), ndjson.relations(records)
            if ents.isEmpty() and rels.isEmpty():
                return
            if incremental:
                files = ents.select(X.file_of(F.col("source_id")).alias("file")).distinct()
                workspace.ingest_changes(ents, rels, files)
            else:
                workspace.write(ents, rels)
        finally:
            records.unpersist()

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) per tumbling window of ``events`` (ts, event_type, value), streaming or not; in a
    stream events later than ``late`` behind the latest are left out and closed windows are forgotten."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")
