"""Usage totals kept by increments: each batch adds a row a user, and readers add up the runs (see ``sources.runs``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.usage import valid_usage
from palaver.sources.runs import BEGIN, Run, Runs

COUNTS = ["input_tokens", "output_tokens", "total_tokens"]
TOTALS = "user_id bigint, username string, named_seq bigint, requests bigint, input_tokens bigint, output_tokens bigint, total_tokens bigint"


def _summed(rows: DataFrame) -> DataFrame:
    """One row a user; the newest name given counts, and sums that cancel out are kept until all runs are merged."""
    sums = [F.sum(c).alias(c) for c in ("requests", *COUNTS)]
    return rows.groupBy("user_id").agg(F.max_by("username", F.when(F.col("username").isNotNull(), F.col("named_seq"))).alias("username"), F.max("named_seq").alias("named_seq"), *sums)


def apply_usage(changes: DataFrame, path: str, batch: int) -> None:
    """Add a batch of (seq, op, user_id, username, *COUNTS); a batch that is committed is left alone.

    ``op`` is add or retract; a retraction carries the counts that it takes back (of an event that was
    rejected or deleted later).  Events with a missing or negative count are neither.
    """
    runs = Runs(changes.sparkSession, path)
    run = runs.next("usage", batch)
    if run is None:
        return
    sign = F.when(F.col("op") == "add", 1).when(F.col("op") == "retract", -1)
    rows = valid_usage(changes).where(sign.isNotNull()).select(
        F.col("user_id").cast("bigint").alias("user_id"), "username", F.when(F.col("op") == "add", F.col("seq")).alias("named_seq"), sign.cast("bigint").alias("requests"),
        *[(sign * F.col(c)).cast("bigint").alias(c) for c in COUNTS],
    )
    runs.write(run, "totals", _summed(rows))
    runs.commit(run, "usage", batch)
    crowd = runs.crowded()
    if crowd:
        merge(changes.sparkSession, path, crowd)


def merge(spark: SparkSession, path: str, which: list[Run] | None = None) -> None:
    """Runs that follow each other (all, if none are given) as one."""
    runs = Runs(spark, path)
    group = runs.live() if which is None else which
    if len(group) > 1:
        run = Run(group[0].start, group[-1].upto)
        sums = _summed(runs.read("totals", TOTALS, group))
        runs.write(run, "totals", sums.where("requests <> 0 OR total_tokens <> 0") if run.start == BEGIN else sums)
        runs.commit(run)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, username, requests, *COUNTS) of users with requests; the rows read are those of the runs, not the events."""
    runs = Runs(spark, path)
    return _summed(runs.read("totals", TOTALS, runs.live())).where("requests > 0").select("user_id", "username", "requests", *COUNTS)


def leaders(spark: SparkSession, path: str, most: int, by: str = "total_tokens") -> DataFrame:
    return totals(spark, path).orderBy(F.desc(by), "user_id").limit(most)


def rollup(spark: SparkSession, path: str) -> DataFrame:
    """One row: requests, users and the sums of all counts."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", *COUNTS)]
    return totals(spark, path).agg(F.count(F.lit(1)).alias("users"), *sums)
