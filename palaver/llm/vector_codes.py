"""Vector codes by product quantisation, with exact partial-distance search on integers.

Vectors are scaled to integers and cut into equal consecutive parts; every part position has a
codebook of at most 256 entries, refined by a few rounds of assignment and integer means.  The
nearest entry is found by partial distances: the dimensions are taken in descending variance of
the codebook, and an entry is dropped once its sum strictly exceeds the best complete distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from palaver.llm.common import scratch

#: Dimensions summed for all entries before the first complete distance is taken as a bound.
LEAD = 4
#: Share of the pairs below which those left are carried on as a list.
FEW = 1 / 10
#: Entries times vectors that are compared at once.
PAIRS = 1 << 16
#: Groups whose sums are small enough to be sent to all tasks (a number of 8 bytes and a key each).
BROADCAST_GROUPS = 100_000
#: Copies of the sums where there are more groups; each serves a part of a group's rows.
SALTS = 32


@dataclass
class Codebooks:
    """Integer entries by part position: an array of (entries, components) each."""

    parts: list[np.ndarray]
    scale: int

    def digest(self) -> str:
        """sha256 of all components as decimal integers by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.parts for x in book.ravel()).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def largest(width: int) -> int:
    """The largest integer component whose squared distances over ``width`` components stay below 2^62."""
    return isqrt((1 << 60) // max(width, 1))


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) by vector and component; shorter vectors are followed by zeros."""
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    most = largest(width)
    with np.errstate(over="ignore"):
        numbers = np.clip(np.floor(values[offsets[0] : offsets[-1]] * scale), -most, most).astype(np.int64)
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return numbers.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = numbers
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of every row, ties to the lower index."""
    index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    if not len(x) or not book.shape[1]:
        return index, distance
    reach = int(max(x.max(), book.max())) - int(min(x.min(), book.min()))
    kind = np.int32 if reach * reach * book.shape[1] < 1 << 31 else np.int64
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    # components first, so that a dimension is one run of memory
    rows, entries = np.ascontiguousarray(x[:, order].T.astype(kind)), np.ascontiguousarray(book[:, order].T.astype(kind))
    step = max(1, PAIRS // len(book))
    for a in range(0, len(x), step):
        index[a : a + step], distance[a : a + step] = _nearest(np.ascontiguousarray(rows[:, a : a + step]), entries)
    return index, distance


def _nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (components, vectors) and (components, entries), both in the order of search.

    The sums of all pairs stand in a block until the mask of those within their vector's best
    complete distance leaves few; from there on only these are carried on, as a list.
    """
    width, n = rows.shape
    partial, gap = np.zeros((2, n, entries.shape[1]), dtype=rows.dtype)
    best, d, alive = None, 0, np.ones(partial.shape, dtype=bool)
    while d < width and (best is None or np.count_nonzero(alive) > alive.size * FEW):
        for _ in range(min(LEAD if best is None else 2, width - d)):
            np.subtract(rows[d][:, None], entries[d], out=gap)
            np.multiply(gap, gap, out=gap)
            partial += gap
            d += 1
        if best is None or d == 2 * LEAD:  # complete the nearest so far, and bound the others by it
            whole = ((rows - entries[:, partial.argmin(axis=1)]) ** 2).sum(axis=0, dtype=rows.dtype)
            best = whole if best is None else np.minimum(best, whole)
        alive = partial <= best[:, None]
    row, entry = np.nonzero(alive)
    partial = partial[alive]
    for d in range(d, width):
        step = rows[d, row] - entries[d, entry]
        partial += step * step
        keep = partial <= best[row]
        row, entry, partial = row[keep], entry[keep], partial[keep]
    least = np.minimum.reduceat(partial, np.searchsorted(row, np.arange(n)))
    at = np.flatnonzero(partial == least[row])
    at = at[np.searchsorted(row[at], np.arange(n))]
    return entry[at], least.astype(np.int64)


def _cut(numbers: np.ndarray, parts: int) -> list[np.ndarray]:
    w = numbers.shape[1] // parts
    return [numbers[:, p * w : (p + 1) * w] for p in range(parts)]


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks of the usable vectors: the first ones by id to begin with, then ``rounds`` means over all.

    Ids that repeat are ordered by their vectors; null ids come last.  A codebook is parts x entries
    short arrays, whatever the table's size: that alone passes through the driver.  Each task adds up
    its vectors by entry, so a round shuffles one row an entry and task.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte a part: 1 to 256 entries")
    plain = vectors.select(F.col(vec_id).alias("i"), F.col(vector).alias("v")).where(usable(F.col("v")))
    first = [r["v"] for r in plain.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return Codebooks([np.zeros((0, 0), dtype=np.int64)] * parts, scale)
    longest = plain.agg(F.max(F.size("v"))).first()[0]
    width = -(-longest // parts) * parts
    w = width // parts
    books = Codebooks(_cut(whole_numbers(pa.array(first, pa.list_(pa.float64())), width, scale), parts), scale)
    names = [f"s{d}" for d in range(w)]
    schema = ", ".join(["cell int", "n long", *(f"{c} long" for c in names)])
    for _ in range(rounds):

        def summed(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            sizes = [len(b) for b in books.parts]
            counts, sums = [np.zeros(k, np.int64) for k in sizes], [np.zeros((k, w), np.int64) for k in sizes]
            for batch in batches:
                for p, x in enumerate(_cut(whole_numbers(batch.column(0), width, scale), parts)):
                    index, _ = nearest(x, books.parts[p])
                    counts[p] += np.bincount(index, minlength=sizes[p])
                    by = np.argsort(index, kind="stable")
                    used = np.unique(index)
                    if w and len(used):
                        sums[p][used] += np.add.reduceat(x[by], np.searchsorted(index[by], used), axis=0)
            for p in range(parts):
                used = np.flatnonzero(counts[p])
                columns = [(used + p * entries).astype(np.int32), counts[p][used], *(sums[p][used, d] for d in range(w))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "n", *names])

        total = plain.select("v").mapInArrow(summed, schema).groupBy("cell")
        found = total.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect()
        new = [b.copy() for b in books.parts]
        for r in found:
            new[r["cell"] // entries][r["cell"] % entries] = [int(r[c]) // r["n"] for c in names]
        books = Codebooks(new, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The table's other columns, with ``code`` (a byte a part) and ``error`` (long), in structs ``row`` and ``found``.

    Rows whose vector is null or holds null or non-finite components are left out.  Vectors longer
    than the codebooks' are cut at their end; shorter ones count as followed by zeros.
    """
    others = [c for c in vectors.columns if c != vector]
    width = sum(b.shape[1] for b in books.parts)
    slim = vectors.where(usable(F.col(vector))).select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.slice(vector, 1, max(width, 1)).alias("v"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = _cut(whole_numbers(batch.column(1), width, books.scale), len(books.parts))
            found = [nearest(x, b) for x, b in zip(cuts, books.parts, strict=True)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())], names=["row", "code", "error"])

    row = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(coded, f"row {row}, code binary, error long")


def codebook_table(spark: SparkSession, books: Codebooks) -> DataFrame:
    """The entries as a table (part, entry, components), from which codes are turned back into vectors."""
    rows = [(p, e, [int(x) for x in entry]) for p, book in enumerate(books.parts) for e, entry in enumerate(book)]
    return spark.createDataFrame(rows, "part int, entry int, components array<bigint>")


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """``codes`` with the approximate vectors that they stand for, as ``approximate`` (doubles)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(code)).to_pylist()), np.uint8).reshape(batch.num_rows, len(books.parts))
            found = np.concatenate([b[at[:, p]] for p, b in enumerate(books.parts)], axis=1) / books.scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.float64()))], names=[*batch.schema.names, "approximate"])

    return codes.mapInArrow(decoded, StructType([*codes.schema.fields, StructField("approximate", ArrayType(DoubleType()))]))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **fitting: int) -> tuple[DataFrame, Codebooks]:
    """(vec_id, code, error, label_error) of every usable vector, and the codebooks.

    Vectors that are null or hold null or non-finite components are left out; an empty table gives
    empty codebooks.  Repeated rows are coded each.  Vectors of several lengths count as followed by
    zeros up to the longest (rounded up to a multiple of the parts).  Integers beyond ``largest``
    (2^28 for parts of 16) count as that, so that no sum overflows; label_error stops at 2^63 - 1.
    Null labels are one label.  Other columns are not read.

    The error of a label is summed before it is shuffled, and joined back as a broadcast up to
    ``BROADCAST_GROUPS`` labels; beyond, each sum has ``SALTS`` copies that share the rows of its
    label, so that a label of very many rows is several tasks.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    books = fit(slim, "vec_id", "vector", **fitting)
    path = scratch(spark, "codes")
    encode(slim, books, "vector").select("row.vec_id", "row.label", "code", "error").write.parquet(path)
    coded = spark.read.parquet(path)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums_path = scratch(spark, "label-errors")
    coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("bigint").alias("label_error")).write.parquet(sums_path)
    sums = spark.read.parquet(sums_path).withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_GROUPS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = coded.withColumn("share", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
        joined = salted.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("share") == F.col("salt")))
    return joined.select(F.col("vec_id").alias(vec_id), "code", "error", "label_error"), books
