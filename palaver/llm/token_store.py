"""Token files: each document's ids as one zstandard frame under a shared dictionary.

A store is a folder in the shared file system: ``frames`` (blocks of whole frames in doc_id order,
each block with its first and last id, its documents' ids, frame offsets, token counts and the
dictionary's hash) and ``dictionary`` (hash and bytes).  A short document is read by finding its
block through the block's id range and decompressing its frame alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.common import scratch
from palaver.llm.tokens import crc32_of, encoded_slices

#: The dictionary is trained on about so many documents, chosen by a hash of their id and text.
TRAINING_DOCS = 2000
DICTIONARY_BYTES = 64 << 10
#: Documents of more tokens need no dictionary and are left out of its sample.
LONGEST_SAMPLE = 1 << 15
#: A block is closed once it holds so many bytes of frames.
BLOCK_BYTES = 1 << 20


def packed(ids: np.ndarray) -> bytes:
    """The serialized form of an id array: all low halves, then all high halves of the 32 bits."""
    low = (ids & 0xFFFF).astype("<u2")
    high = (ids >> 16).astype("<u2")
    return low.tobytes() + (high.tobytes() if high.any() else b"")


def unpacked(data: bytes, n: int) -> np.ndarray:
    halves = np.frombuffer(data, dtype="<u2").astype("<u4")
    return halves[:n] if len(halves) == n else halves[:n] | (halves[n:] << 16)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = TRAINING_DOCS) -> bytes:
    """A zstandard dictionary from a bounded sample, chosen by a hash of the rows.

    Where the sample is too small for the training, its own bytes are the dictionary (as raw
    content).  The sample decides the frames' size alone, never their content.
    """
    total = docs.count()
    every = max(1, -(-total // sample_docs))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, before in encoded_slices(batches, 1, tokenizer, end_id):
            data = [packed(ids[a:b]) for a, b in zip(before[:-1], before[1:], strict=True) if b - a <= LONGEST_SAMPLE]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["data"])

    samples = [bytes(r["data"]) for r in chosen.mapInArrow(serialized, "data binary").limit(2 * sample_docs).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(samples))[-DICTIONARY_BYTES:].rjust(8, b"\0")


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


BLOCKS = "part int, block int, start long, first_id long, last_id long, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, dictionary string, frames binary"
BLOCK_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3, pa.string(), pa.binary()]


def write_store(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Tokenize, compress and write all documents in ascending id order (nulls first).

    Null texts count as empty; texts of any length are one frame; rows of one id, and those without
    one, stay apart and in the order in which they were read.  An empty table makes a store without
    blocks.  Other columns are not read, whatever their names.

    Texts become frames where they are read; only frames are sorted, by id and place, so that rows
    of one id may lie in several parts.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dictionary = train_dictionary(slim, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tool = TaskContext.get().partitionId() << 33, compressor(dictionary)
        for rows, ids, before in encoded_slices(batches, 1, tokenizer, end_id):
            frames = [tool.compress(packed(ids[a:b])) for a, b in zip(before[:-1], before[1:], strict=True)]
            places = np.arange(place, place + len(frames))
            place += len(frames)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(places), pa.array(np.diff(before)), pa.array(frames, pa.binary())], names=["doc_id", "place", "n", "frame"])

    unordered = scratch(spark, "frames")
    slim.mapInArrow(encoded, "doc_id long, place long, n long, frame binary").write.option("compression", "none").parquet(unordered)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, tokens, size, held = TaskContext.get().partitionId(), 0, 0, 0, 0, []

        def closed() -> pa.RecordBatch:
            ids, counts, frames = zip(*held, strict=True)
            known = [x for x in ids if x is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            row = [part, block, start, known[0] if known else None, known[-1] if known else None, list(ids), list(counts), offsets.tolist(), digest, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, BLOCK_KINDS, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.append(row)
                tokens, size = tokens + row[1], size + len(row[2])
                if size >= BLOCK_BYTES:
                    yield closed()
                    block, start, size, held = block + 1, tokens, 0, []
        if held:
            yield closed()

    ordered = spark.read.parquet(unordered).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    ordered.select("doc_id", "n", "frame").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/frames")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``before``: the tokens of all parts ahead of theirs."""
    frames = spark.read.parquet(f"{path}/frames")
    parts = frames.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per part
    return frames.join(parts.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part")


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode all documents: doc_id, start, n_tokens, ids_crc32 (and ids as bytes); an empty store gives no rows."""
    dictionary = {r["hash"]: bytes(r["data"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {k: decompressor(v) for k, v in dictionary.items()}
        for batch in batches:
            for block in batch.to_pylist():
                tool, at, out = tools[block["dictionary"]], block["before"] + block["start"], []
                for own, n, a, b in zip(block["doc_ids"], block["n_tokens"], block["offsets"], block["offsets"][1:], strict=False):
                    ids = unpacked(tool.decompress(block["frames"][a:b]), n)
                    out.append((own, at, n, crc32_of(ids), *((ids.tobytes(),) if with_ids else ())))
                    at += n
                kinds = [*[pa.int64()] * 4, *([pa.binary()] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    chosen = read_frames(spark, path).select("before", "start", "doc_ids", "n_tokens", "offsets", "dictionary", "frames")
    return chosen.mapInArrow(documents, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row with that id; none for an unknown one), from its own frames alone.

    Parquet's statistics of ``first_id`` and ``last_id`` leave out all files and row groups but those
    with blocks around the id.
    """
    near = spark.read.parquet(f"{path}/frames").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id).cast("bigint")))
    own = F.filter(F.transform("doc_ids", lambda d, i: F.when(d == doc_id, i)), lambda i: i.isNotNull())
    one = near.select("part", "block", "dictionary", "n_tokens", F.posexplode(own).alias("nth", "i"), "offsets", "frames")
    frame = F.expr("substring(frames, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int))")
    rows = one.select("part", "block", "nth", "dictionary", F.expr("n_tokens[i]").alias("n"), frame.alias("frame")).orderBy("part", "block", "nth").collect()
    dictionary = {r["hash"]: bytes(r["data"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    return [unpacked(decompressor(dictionary[r["dictionary"]]).decompress(bytes(r["frame"])), r["n"]) for r in rows]


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a store under the shared folder and read it back; rows as of write_store() and read_store()."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_store(docs, tokenizer, path, doc_id, text)
    return read_store(spark, path)
