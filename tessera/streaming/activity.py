"""The daily series on a stream, and an index that follows its documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time with a zone, which is that of the session."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Messages of each day, late ones included up to a watermark; the batch version is operators.activity.daily()."""
    day = F.window(ts, "1 day")
    return _timed(events, ts).withWatermark(ts, late).groupBy(day.alias("w")).agg(F.count("*").alias("messages")).select(F.to_date("w.start").alias("day"), "messages")


def daily_sessions(events: DataFrame, session: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first message of each session and day; count them by day for the sessions of the day."""
    days = _timed(events, ts).withWatermark(ts, late).withColumn("day", F.window(ts, "1 day")["start"])
    return days.dropDuplicatesWithinWatermark(["day", session]).select(F.to_date("day").alias("day"), session)


def run_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now and stop."""
    return rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_result(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole result at path, written anew after each batch, and stop when all that is there is read."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(path)
    return rows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each batch of changed documents to apply(batch, number), which rewrites their part of the index [Z4, Z5].
    A number may come twice after a failure, so apply must overwrite and not add."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rewrite_partitions(path: str, partition: str) -> Callable[[DataFrame, int], None]:
    """An apply() that replaces the partitions that a batch has rows of."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return apply
