"""Usage reports: leaderboard, roll-ups with ratios, quotas, queue and split statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaderboard(usage: DataFrame, by: list[str], counts: list[str], total: str, name: str, most: int) -> DataFrame:
    """Sums by user, the largest first: partial sums, one shuffle, a top-k."""
    sums = [F.round(F.coalesce(F.sum(c), F.lit(0)), 2).alias(c) for c in counts]
    return usage.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("requests")).orderBy(F.desc(total), F.asc(name)).limit(most)


def valid_usage(usage: DataFrame) -> DataFrame:
    return usage.where((F.col("input_tokens") >= 0) & (F.col("output_tokens") >= 0) & (F.col("total_tokens") >= 0))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def estimated_tokens(context: Column, characters: Column) -> Column:
    return 50 * context + F.floor(characters / 4)


def remaining_quota(requests: DataFrame, by: str, at: str, as_of: Column, seconds: int, allowed: int) -> DataFrame:
    """Used and remaining requests of the last window, and when the oldest leaves it."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    recent = F.unix_micros(as_of.cast("timestamp")) - micros < seconds * 1_000_000
    used = F.count_if(recent)
    reset = F.min(F.when(recent, F.col(at))) + F.expr(f"INTERVAL {seconds} SECONDS")
    return requests.groupBy(by).agg(used.alias("used"), F.greatest(F.lit(0), allowed - used).alias("remaining"), reset.alias("resets_at"))


def column_widths(cells: DataFrame, by: list[str], row_cells: str) -> DataFrame:
    """The longest cell of each column of each table."""
    return cells.select(*by, F.posexplode(row_cells).alias("col", "cell")).groupBy(*by, "col").agg(F.max(F.length("cell")).alias("width"))


def split_statistics(parts: DataFrame, by: list[str], text: str, most: int) -> DataFrame:
    """Parts, their characters, mean, least and greatest length, and those that are as long as ``most``; one pass of partial sums."""
    length = F.length(text)
    return parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum(length), F.lit(0)).alias("characters"), F.round(F.avg(length), 4).alias("mean_length"),
        F.min(length).alias("shortest"), F.max(length).alias("longest"), F.count_if(length == most).alias("full_parts"),
    )


def snapshot(rows: DataFrame, by: list[str], **states: Column) -> DataFrame:
    """All rows by group, and how many of them are in each of the named states: the counts that a queue shows."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in states.items()])
