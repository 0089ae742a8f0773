"""Packing by power-of-two decomposition: no sequence holds tokens of two documents.

A document of n tokens becomes n div L pieces of the full length L and one piece for each binary
digit of the remainder, longest first.  Every piece is a sequence of its own whose length is a
power of two, so nothing is padded; sequences are numbered bucket by bucket of equal lengths, and
a training batch takes sequences of one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import scratch
from palaver.llm.tokens import crc32_of, encoded_slices

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def binary_pieces(n: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a document's pieces; a longest piece is a power of two."""
    rest = n % longest
    lengths = np.array([longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1], dtype=np.int64)
    return np.cumsum(lengths) - lengths, lengths


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", longest: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``sequence_id`` runs from 0 without gaps over all pieces, longer buckets first; ``offset`` is 0
    as each piece opens its own sequence.  Null and empty texts are the end id alone (one piece of
    length 1); repeated rows are packed each on its own; a text of any length is encoded whole and
    becomes as many pieces as it needs; an empty table gives no rows; other
    columns are not read, so their names don't matter.

    The pieces are written once to the shared folder with their task's number and their count
    within (task, bucket); a sum over those counts gives every bucket's first number per task, so
    that nothing is shuffled but the counts.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {PIECES}" + ", ids binary" * keep_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(longest.bit_length(), dtype=np.int64)
        for rows, ids, before in encoded_slices(batches, 1, tokenizer, end_id):
            cut = [binary_pieces(int(n), longest) for n in np.diff(before)]
            counts = np.array([len(x[0]) for x in cut])
            starts, lengths = np.concatenate([x[0] for x in cut]), np.concatenate([x[1] for x in cut])
            row = np.repeat(np.arange(len(cut)), counts)
            at = before[row] + starts
            buckets, nth = np.log2(lengths).astype(np.int64), np.empty(len(lengths), dtype=np.int64)
            for b in np.unique(buckets):
                own = np.flatnonzero(buckets == b)
                nth[own] = seen[b] + np.arange(len(own))
                seen[b] += len(own)
            columns = [
                rows.column(0).take(pa.array(row)), pa.array(starts), pa.array(lengths),
                pa.array([crc32_of(ids[a : a + k]) for a, k in zip(at, lengths, strict=True)], pa.int64()),
                pa.array(np.diff(before)[row]), pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(nth),
            ]
            if keep_ids:
                columns.append(pa.array([ids[a : a + k].tobytes() for a, k in zip(at, lengths, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    path = scratch(spark, "pieces")
    slim.mapInArrow(pieces, schema).write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    counts = written.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    longer = counts.groupBy("length").agg(F.sum("n").alias("n"))  # one row for each of the powers of two
    bucket_first = longer.select("length", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bucket_first"))
    inner = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("part_first")).join(bucket_first, "length")
    numbered = written.join(firsts, ["length", "part"])
    return numbered.select(
        F.col("doc_id").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("bucket_first") + F.col("part_first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
