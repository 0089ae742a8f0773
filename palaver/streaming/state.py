"""The store in which stateful streams keep their keys: timers and lists need RocksDB."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """For the streams that are started from now on; a stream that runs, or ran before, keeps its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
