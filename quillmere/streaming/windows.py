"""Streams of metrics and feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_event_time(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp with a watermark (a timestamp without zone is refused by watermarks)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, every: str = "1 minute", ts: str = "ts", labels: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of each window. [STM2, STM3, AGG14]"""
    grouped = events.groupBy(F.window(ts, every), *labels).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), *labels, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), key, "n")


def poll_feed(
    spark: SparkSession, folder: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "300 seconds", key: str = "doc_id", moment: str | None = None, within: str = "30 days"
) -> StreamingQuery:
    """New JSON files of a folder, each document once, handed to ``sink``. Resumes from the checkpoint; without ``every`` it takes what is there and ends. [STM1, STM7, FLT20]

    With ``moment``, a column of ISO timestamps, a document is known for ``within`` after the latest moment, so the state does not grow for ever;
    what comes later than that is left out. Without it every key is remembered.
    """
    rows = spark.readStream.schema(schema).json(folder)
    if moment:
        timed = rows.withColumn("_moment", F.coalesce(F.try_to_timestamp(moment), F.lit(0).cast("timestamp"))).withWatermark("_moment", within)
        fresh = timed.dropDuplicatesWithinWatermark([key]).drop("_moment")
    else:
        fresh = rows.dropDuplicates([key])
    writer = fresh.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
