"""Report sinks: long CSV, Markdown, and structured log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_format(row: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, value) rows of a summary with one row."""
    return row.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


def markdown_lines(rows: DataFrame, title: str) -> DataFrame:
    """A heading and a bullet for each metric, in order of name (a report of a few dozen lines)."""
    bullets = rows.select(F.lit(1).alias("part"), "metric", F.concat(F.lit("- **"), "metric", F.lit("**: "), F.format_number("value", 2)).alias("value"))
    head = rows.sparkSession.createDataFrame([(0, "", f"# {title}")], "part int, metric string, value string")
    return head.union(bullets).orderBy("part", "metric").select("value")


def log_line(message: Column, **fields: Column) -> Column:
    """The message and its fields as ``message [k=v, ...]``; null fields are left out."""
    parts = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", message).otherwise(F.concat(message, F.lit(" ["), joined, F.lit("]")))
