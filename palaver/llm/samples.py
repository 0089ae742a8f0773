"""Bounded, deterministic samples of labelled documents for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """About ``bound`` (text, label) rows at most, chosen by a hash of the id among the rows to learn from.

    ``learn`` is a condition on ``doc_id``.  Rows without a label or text are left out.  Where
    there are no more than ``bound`` labels all are taken.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & learn)
    every = max(1, -(-known.count() // bound))
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(every)) == 0).dropDuplicates(["doc_id", "label"])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & learn & (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(every)) == 0))
    return texts.join(chosen, "doc_id").select("doc_id", "text", "label")
