"""Corpus cleaning: toxic documents go, near copies, repeated passages and benchmark leaks follow, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result
is written as Parquet and read again as the next one's documents.  All stages but the last return
the columns of what they are given, whatever other columns it has and in its order.

In all stages a row without a doc_id is a row like others; repeated rows are near copies of each
other, so one of them stays; texts of any length are read whole; an empty table stays empty; a null
text stays null.  Texts that lose all their bytes stay as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import doc_bucket, scratch
from palaver.llm.queries import table, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 (operator 10), learned as in its query from the given labels.

    Null and empty texts score by the labels' balance alone, and so stay unless most labels are toxic.
    """
    from palaver.llm.samples import labelled_sample
    from palaver.llm.toxicity import SAMPLE_DOCS, score_toxicity

    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", doc_bucket(F.col("doc_id"), 5) != 0, SAMPLE_DOCS)
    return score_toxicity(docs, sample).where("score < 0.5").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (operator 1): five words, similarity about 0.8.

    Texts without words (null, empty) are copies of each other.
    """
    from palaver.llm.simhash import deduplicated

    return deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur elsewhere (operator 4); n_chars follows the text."""
    from palaver.llm.substrings import remove_repeats

    text = F.when(F.col("doc.text").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    cut = remove_repeats(docs).withColumn("new", text)
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("bigint")}
    return cut.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item (operator 5); texts without words have none."""
    from palaver.llm.decontamination import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("hit_words") == 0).select("doc.*")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of a power of two (operator 3); null and empty texts are an end id."""
    from palaver.llm.packing import pack

    return pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_tokens),
]

#: Learned scores, connected components and tokens have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
