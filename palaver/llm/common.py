"""Helpers shared by the training-data operators: shared storage, checkpoints, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that one step of a Python task holds at once (a single longer text is held whole).
SLICE_BYTES = 3 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where a session on one machine names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="palaver-shared-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a table that is written and read again."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; a lost executor loses nothing of it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also fold other letters)."""
    return F.translate(text, UPPER, UPPER.lower())


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fixed split into learning and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def give_back() -> None:
    """Return to the system what Arrow and the C library have kept for reuse: a worker waits long between its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batches: Iterable[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds at most ``most`` bytes of text, or one row.

    At the end the worker gives back the memory that Arrow has kept for reuse.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def with_text(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Put a struct column's text field beside the batch's columns; nothing is copied or sent twice."""
    for batch in batches:
        field = batch.column(0).field(text)
        yield pa.RecordBatch.from_arrays([*batch.columns, field], names=[*batch.schema.names, "_text"])


#: What this Python worker holds between tasks, under its key.
_HELD: tuple[object, object] | None = None


def held(key: object, make: Callable[[], T]) -> T:
    """A cache that stays with the Python worker; one at a time, so operators' caches don't add up."""
    global _HELD
    if _HELD is None or _HELD[0] != key:
        _HELD = None
        _HELD = (key, make())
    return _HELD[1]


def word_table(texts: pa.Array, separators: str = " ") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Split texts at single separator characters.

    Returns the words' codes in order, for each text the number of words before it (and the
    total at the end), and the distinct words by code.  Empty words are kept; null counts as ''.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    for other in separators[1:]:
        texts = pc.replace_substring(texts, other, separators[0])
    split = pc.split_pattern(texts, separators[0])
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], words.dictionary.to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... (length numbers) for each pair, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
