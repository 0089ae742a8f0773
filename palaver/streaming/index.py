"""Message index kept up by a stream of change events, and micro-batches of live chat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import changes, fulltext
from palaver.operators.changes import BACKFILL

LOG_SCHEMA = "seq bigint, op string, message_id bigint, content string, author_name string, attachment_summary string, ts timestamp"


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """Change events as a stream of Parquet files."""
    return spark.readStream.schema(LOG_SCHEMA).parquet(path)


def maintain_index(events: DataFrame, path: str, checkpoint: str):
    """Keep message state and full-text index by the stream, exactly once: a batch that is run again is known by its number."""
    return events.writeStream.foreachBatch(lambda b, i: fulltext.keep_up(b, path, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, path: str) -> DataFrame:
    """The state of every message; of the runs since the last merge only the messages that they touch are grouped."""
    return fulltext.current_state(spark, path)


def compact(spark: SparkSession, path: str) -> None:
    """One run of all; readers take it from the moment of its commit."""
    fulltext.merge(spark, path)


def backfill(history: DataFrame, path: str, number: int, own_bot: int | None = None, most: int = BACKFILL) -> DataFrame:
    """Bring the channels' newest messages into the index as a batch of its own; (channel_id, messages, indexed).

    ``number`` tells backfills apart: one that is run again changes nothing.  What the index has of a
    message already stays, unless the message is newer.  One writer at a time: before the stream of
    events is started, or between two of its runs.
    """
    events, counts = changes.backfill(history, own_bot, most)
    fulltext.keep_up(events, path, number, source="backfill")
    return counts


def live_batches(messages: DataFrame, reply: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 2):
    """Hand each micro-batch of live messages to ``reply``, at most one every ``seconds``."""
    return messages.writeStream.foreachBatch(reply).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def windowed_counts(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per key and window of event time; rows later than ``late`` are dropped with their window."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width), by).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", by, "n")
