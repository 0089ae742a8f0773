"""Removal of long strings that occur elsewhere, by bucket-pointer refinement over sampled suffixes.

Suffixes are sampled at minimizers: in each string of ``length`` bytes the q-gram of least hash, so
that two equal strings have the same sampled place in them.  A sampled suffix's first bucket is its
q-gram's hash.  Buckets of one suffix can't begin a repeat and are dropped.  Contexts (the bytes
around a suffix that its strings of ``length`` bytes cover) that occur twice are repeats as a whole.
For a context that occurs once, but shares its q-gram with another, the strings are compared: the
contexts of a bucket come to one task, where every place points to the bucket of its first bytes, and
buckets are refined by sorting places on their own pointer and that of a later place; each round's
pointers are those that the next one sorts on, and places that are alone in their bucket drop out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import checkpoint, give_back, ranges, scratch, text_slices, with_text
from palaver.llm.subwords import mixed

Q = 40
#: Odd factors of the identifiers, one for each doubling; fixed, so that all tasks name buckets alike.
FACTORS = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(20).integers(1 << 40, 1 << 62, 40)]


def doubled(data: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Identifiers of all strings of 1, 2, 4, ... bytes, and those of ``length`` bytes, by position.

    An identifier of n bytes is made of those of the first and the last n/2 bytes (which overlap
    where n isn't twice the step below it).
    """
    levels = [mixed(data.astype(np.uint64) + np.uint64(1))]
    size = 1
    while 2 * size <= length and len(levels[-1]) > size:
        last = levels[-1]
        levels.append(mixed(last[:-size] * FACTORS[len(levels)] + last[size:]))
        size *= 2
    return levels, joined(levels, length)


def joined(levels: list[np.ndarray], length: int) -> np.ndarray:
    """Identifiers of ``length`` bytes from two overlapping ones of the largest power of two in it."""
    n = len(levels[0]) - length + 1
    k = length.bit_length() - 1
    if n <= 0 or k >= len(levels):
        return np.zeros(0, dtype=np.uint64)
    top = levels[k]
    return mixed(top[:n] * FACTORS[-1] + top[length - (1 << k) : length - (1 << k) + n] + np.uint64(length))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of the leftmost least one."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, size = h.copy(), np.arange(len(h), dtype=np.int32), 1
    while 2 * size <= width:
        take = best[size:] < best[:-size]
        at = np.where(take, at[size:], at[:-size])
        best = np.where(take, best[size:], best[:-size])
        size *= 2
    shift = width - size
    left, right = best[:n], best[shift : shift + n]
    return np.where(right < left, at[shift : shift + n], at[:n])


#: Contexts of one q-gram that a task compares at once; a larger bucket is cut into blocks of this size.
BLOCK = 256
#: Contexts that a task holds at once, in bytes.
CHUNK_BYTES = 1 << 18
#: Neighbouring strings of a context that share one identifier of their common middle.
FAMILY = 20
TOP = 7  # the doubling whose identifiers stand for 128 bytes


#: Bytes that the first buckets of a comparison are made of.
FIRST = 8


def bucket_pointers(data: np.ndarray, length: int) -> np.ndarray:
    """For each place the bucket of the ``length`` bytes from there on; equal buckets are equal bytes.

    The first buckets hold places of equal FIRST bytes.  A round makes buckets of up to twice as
    many bytes: places of a bucket are told apart by the buckets of the places behind.
    """
    n = len(data) - FIRST + 1
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, FIRST)).view(np.uint64).ravel()
    _, pointer, count = np.unique(first, return_inverse=True, return_counts=True)
    pointer, size, used = pointer.astype(np.int64), FIRST, len(count)
    live = np.flatnonzero(count[pointer] > 1)
    while size < length and len(live):
        step = min(size, length - size)
        size += step
        live = live[live + step < n]
        pairs = pointer[live] * np.int64(used) + pointer[live + step]
        _, new, count = np.unique(pairs, return_inverse=True, return_counts=True)
        pointer[live] = new + used  # beyond those of the places that dropped out
        used += len(count)
        live = live[count[new] > 1]
    return pointer


def span_ids(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Identifiers of strings of 200 to 372 bytes from three of 128 bytes that cover them."""
    top, size = levels[TOP], last - first
    middle = first + np.minimum(116, size - 128)
    h = mixed(top[first] * FACTORS[-2] + top[middle])
    return mixed(h * FACTORS[-3] + top[last - 128] + size.astype(np.uint64))


def _anchors(length: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 1):
            out = []
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                if len(data) < length:
                    continue
                levels, _ = doubled(data, 128)
                place = window_minima(joined(levels, Q), length - Q + 1)
                anchors, first, count = np.unique(place, return_index=True, return_counts=True)
                last = first + count - 1 + length
                grams = joined_at(levels, Q, anchors)
                out.append((np.full(len(anchors), key), first, last, grams, span_ids(levels, first, last), anchors - first))
            if out:
                key, first, last, grams, spans, at = (np.concatenate([o[k] for o in out]) for k in range(6))
                arrays = [pa.array(key, pa.int64()), pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int16)), pa.array(grams.view(np.int64)), pa.array(spans.view(np.int64)), pa.array(at.astype(np.int16))]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "first", "size", "gram", "span", "at"])

    return found


def joined_at(levels: list[np.ndarray], length: int, at: np.ndarray) -> np.ndarray:
    k = length.bit_length() - 1
    return mixed(levels[k][at] * FACTORS[-1] + levels[k][at + length - (1 << k)] + np.uint64(length))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the bytes of the listed spans out of their texts."""
    for rows in text_slices(batches, 0):
        out: dict[str, list] = {n: [] for n in ("k", "first", "at", "gram", "block", "blocks", "copies", "bytes")}
        for text, k, spans in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
            data = text.encode()
            for s in spans:
                for n in ("first", "at", "gram", "block", "blocks", "copies"):
                    out[n].append(s[n])
                out["k"].append(k)
                out["bytes"].append(data[s["first"] : s["first"] + s["size"]])
        kinds = [pa.int64(), pa.int32(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(out, kinds, strict=True)], names=list(out))


def _compared(length: int):
    """Strings of ``length`` bytes that two contexts of a block share, byte for byte, and what other blocks must know.

    Rows with a core are for buckets that were cut into blocks: a block's distinct strings, by the
    identifier of the middle that FAMILY neighbouring strings have in common.  A string has its
    owner (k, first) where one context alone holds it; else k is 0 and first -1.
    """
    middle = length - FAMILY + 1

    def settle(held: list[dict]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join([h["bytes"] for h in held]), dtype=np.uint8)
        column = lambda name: np.array([h[name] for h in held], dtype=np.int64)
        sizes = np.array([len(h["bytes"]) for h in held])
        windows = sizes - length + 1
        own = np.repeat(np.arange(len(held)), windows)
        inner = ranges(np.zeros(len(held), dtype=np.int64), windows)
        at = inner + np.repeat(np.cumsum(sizes) - sizes, windows)
        _, once, place, count = np.unique(bucket_pointers(data, length)[at], return_index=True, return_inverse=True, return_counts=True)
        single, shared = (column("copies") == 1)[own], count[place] > 1
        k, first = column("k")[own], column("first")[own] + inner
        # spans that occur twice are removed as they are; others only where a string is shared
        hit = np.flatnonzero(shared & single)
        if len(hit):
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (own[hit[1:]] != own[hit[:-1]]) | (inner[hit[1:]] != inner[hit[:-1]] + 1)
            starts = np.flatnonzero(new)
            a, b = hit[starts], hit[np.append(starts[1:], len(hit)) - 1]
            none = np.zeros(len(a), dtype=np.int64)
            yield batch(k[a], first[a], first[b] + length, none, none, np.zeros(len(a) + 1, dtype=np.int64), [none[:0]] * 3)
        cut = once[(column("blocks") > 1)[own[once]]]
        if len(cut):  # names of strings that other tasks use as well
            top = doubled(data, 128)[0][TOP]
            ids = mixed(top[at] * FACTORS[-1] + top[at + length - 128] + np.uint64(length))
            before = column("at")[own[cut]] - inner[cut]
            start = at[cut] + before % FAMILY
            cores = mixed(top[start] * FACTORS[-1] + top[start + middle - 128] + np.uint64(middle)).view(np.int64)
            order = np.argsort(cores, kind="stable")
            cut, cores = cut[order], cores[order]
            heads = np.flatnonzero(np.append(True, cores[1:] != cores[:-1]))
            mine = single[cut] & ~shared[cut]
            lists = [ids[cut].view(np.int64), np.where(mine, k[cut], 0), np.where(mine, first[cut], -1)]
            none = np.zeros(len(heads), dtype=np.int64)
            yield batch(none, none - 1, none, column("gram")[own[cut[heads]]], cores[heads], np.append(heads, len(cut)), lists)

    def batch(k, first, last, gram, core, offsets, lists) -> pa.RecordBatch:
        values = [np.asarray(x).astype(np.int64) for x in (k, first, last, gram, core)]
        nested = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in lists]
        return pa.RecordBatch.from_arrays([*map(pa.array, values), *nested], names=["k", "first", "last", "gram", "core", "ids", "ks", "firsts"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for rows in batches:
            for row in rows.to_pylist():
                group = (row["gram"], row["block"])
                if size >= CHUNK_BYTES and group != last:
                    yield from settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
                last = group
        if held:
            yield from settle(held)
        give_back()

    return compared


def merged(spans: list) -> list[tuple[int, int]]:
    """Overlapping and touching (first, last) spans as maximal runs."""
    runs: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or []):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [tuple(r) for r in runs]


def _cut(text: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(with_text(batches, text), 2):
            kept, runs = [], []
            for whole, spans in zip(rows.column(2).to_pylist(), rows.column(1).to_pylist(), strict=True):
                data, own, at, parts = (whole or "").encode(), merged(spans), 0, []
                for first, last in own:
                    parts.append(data[at:first])
                    at = last
                kept.append(b"".join([*parts, data[at:]]))
                runs.append([{"first": a, "last": b} for a, b in own])
            spans = pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), spans, pa.array(kept, pa.binary()), texts], names=["doc", "removed", "kept", "kept_text"])

    return cut


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(k, spans) of documents (k long, text): the unmerged (first, last) bytes of repeated strings."""
    spark = docs.sparkSession
    path = scratch(spark, "suffixes")
    docs.mapInArrow(_anchors(length), "k long, first int, size short, gram long, span long, at short").write.parquet(path)
    anchors = spark.read.parquet(path)
    buckets = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("a"), F.max("span").alias("b"))
    # written before it is joined: a frequent q-gram's suffixes can then be dealt to several tasks
    buckets = checkpoint(buckets.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")))
    path = scratch(spark, "buckets")
    anchors.join(buckets, "gram").write.parquet(path)
    live = spark.read.parquet(path)

    place = F.struct("k", "first", "size", "at")
    spans = live.where("mixed").groupBy("gram", "span").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at"))
    spans = checkpoint(spans)
    twice = live.where("mixed").join(spans.where("copies > 1").select("gram", "span"), ["gram", "span"], "left_semi").unionByName(live.where("not mixed"))
    whole = twice.select("k", F.col("first").cast("long").alias("first"), (F.col("first") + F.col("size")).cast("long").alias("last"))

    sizes = checkpoint(spans.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long").alias("blocks")))
    listed = spans.join(sizes, "gram").withColumn("block", F.pmod(F.xxhash64("span"), F.col("blocks")))
    listed = listed.select("at.k", F.struct("at.first", "at.size", "at.at", "gram", "block", "blocks", "copies").alias("s")).groupBy("k").agg(F.collect_list("s").alias("spans"))
    # equal texts share a key and a span has one owner: one of them shows its contexts, copies are counted already
    cut = docs.dropDuplicates(["k"]).join(listed, "k").select("text", "k", "spans").mapInArrow(_contexts, "k long, first int, at short, gram long, block long, blocks long, copies long, bytes binary")
    dealt = cut.repartition("gram", "block").sortWithinPartitions("gram", "block")
    found = dealt.mapInArrow(_compared(length), "k long, first long, last long, gram long, core long, ids array<bigint>, ks array<bigint>, firsts array<bigint>")
    path = scratch(spark, "strings")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    # cut buckets: first the middles that several blocks have, then their strings
    open_ = found.where("first < 0").select("gram", "core", "ids", "ks", "firsts")
    cores = checkpoint(open_.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "core"))
    strings = checkpoint(open_.join(cores, ["gram", "core"], "left_semi").select("gram", F.explode(F.arrays_zip("ids", "ks", "firsts")).alias("s")).select("gram", F.col("s.ids").alias("id"), F.col("s.ks").alias("k"), F.col("s.firsts").alias("first")))
    again = checkpoint(strings.groupBy("gram", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "id"))
    across = strings.where("first >= 0").join(again, ["gram", "id"], "left_semi").select("k", "first", (F.col("first") + length).alias("last"))
    parts = whole.union(found.where("first >= 0").select("k", "first", "last")).union(across)
    return parts.groupBy("k").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """All columns of ``docs`` (in struct ``doc``), ``removed`` (maximal byte runs), ``kept`` (bytes left)
    and ``kept_text`` (the same as text, without characters of which a part was removed).

    A byte is removed if a string of ``length`` bytes (200 to 300) that covers it also starts
    anywhere else, in the same text or another; overlaps count, and all strings are judged on the
    input.  Null texts count as empty; shorter texts and empty tables have nothing to remove;
    repeated rows are repeats of each other; texts of any length are searched whole, one at a time
    where they are long; other columns are carried along, whatever their names.  Texts are known to
    each other by 64 bits of hash.
    """
    if not 200 <= length <= 240:
        raise ValueError("the identifiers of this module cover strings of 200 to 240 bytes")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # equal texts share a key: their strings are counted for each of them, and removed alike
    keyed = whole.select(F.xxhash64("text").alias("k"), "doc", "text")
    spans = repeated_spans(keyed.select("k", "text"), length)
    both = keyed.select("k", "doc").join(spans, "k", "left").select("doc", "spans")
    return both.mapInArrow(_cut(text), f"doc {whole.schema['doc'].dataType.simpleString()}, removed array<struct<first: bigint, last: bigint>>, kept binary, kept_text string")
