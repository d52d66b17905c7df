"""Incremental maintenance as a stream: each micro-batch of changed files is one update of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.plans import incremental
from codeloom.plans.store import Index
from codeloom.sources.golang import BUDGET
from codeloom.schemas import SCAN


def apply_changes(index: Index, changed: DataFrame, budget: int = BUDGET) -> incremental.Run | None:
    """An update by scan rows of changed files alone; size -1 deletes a path. Of several rows of a path the latest counts.

    The rest of the stored files is taken as unchanged. Applying a batch again changes nothing, so a replay after a failure is safe.
    """
    last = changed.groupBy("path").agg(F.max_by(F.struct(*(c for c in SCAN.names if c != "path")), "mtime").alias("r")).select("path", "r.*").select(*SCAN.names)
    if index.manifest["state"] == "empty":
        incremental.build(index, last.filter("size >= 0"), budget)
        return None
    stored = index.read("files").select("path", "lang", "size", "mtime", "hash", "skip").withColumn("content", F.lit(None).cast("binary"))
    whole = stored.join(last.select("path"), "path", "left_anti").unionByName(last.filter("size >= 0"))
    return incremental.update(index, whole, budget)


def maintain(stream: DataFrame, path: str, checkpoint: str, budget: int = BUDGET, **trigger: object) -> StreamingQuery:
    """Starts a query that keeps the index at ``path`` up to a stream of scan rows."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply_changes(Index(batch.sparkSession, path), batch, budget)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_rates(events: DataFrame, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, with a watermark; runs on a stream and on a table alike."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
