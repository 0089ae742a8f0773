"""The session that the library expects: UTC, ANSI SQL, adaptive execution."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "palaver", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **more}).getOrCreate()


def shared_folder(spark: SparkSession, name: str, own: str | None = None) -> str:
    """A folder where driver and executors can write tables; of this machine only where all of Spark runs on it.

    ``own`` tells folders of one name apart; without it the folder is a new one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="palaver-"))
        path = spark.sparkContext.getCheckpointDir()
    return f"{path.rstrip('/')}/{name}-{own or uuid.uuid4().hex}"


def checkpoint(rows: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; what is lost with an executor is read again from there."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return rows.checkpoint(eager=True)
