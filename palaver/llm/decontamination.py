"""Removal of benchmark text from training documents.

Main path: DataFrame functions only.  Benchmark items become windows of consecutive words.  Each
document is split into words once; filters of hashes (of a window's first words, then of the whole
window) as large as the benchmark asks for leave few of its windows, and those meet the broadcast
hash set of the benchmark's windows, where hash and text must agree.  A benchmark too large for such
filters is met by the windows' hashes alone first, by shuffle.  The words under hits and the items
follow per document; only they are joined back to it, not the texts' words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import ascii_lower, checkpoint, scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Windows that take so many bytes together are broadcast; a larger set is joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Slots of a filter for each window (a byte each), probes of a window, and the fewest and most slots of a filter.
#: With 16 slots and 3 probes one window in 200 passes that isn't one of the benchmark's.
SLOTS_PER_WINDOW, PROBES = 16, 3
FEWEST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 26


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(ascii_lower(text))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def slots_for(windows: int) -> int:
    """A power of two."""
    return min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (windows * SLOTS_PER_WINDOW - 1).bit_length()))


def slot_of(slots: int, hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(slots)).cast("int")


def probes_of(slots: int, hashed: Column) -> list[Column]:
    """The slots of a window by its hash: different bits of it, as it is and mixed."""
    return [slot_of(slots, hashed if k == 0 else F.xxhash64(hashed, F.lit(k))) for k in range(PROBES)]


def filled(slots: int, marked_slots: DataFrame) -> Column:
    """A literal with a byte for each slot, 1 where ``marked_slots`` (one int column) has it.

    The slots come as one bit string for each range of them, so that what passes the driver is an
    eighth of the literal, whatever the benchmark's size.
    """
    # numbers from 1 on, as Spark's bitmaps have them
    ranges = marked_slots.toDF("s").distinct().select(F.bitmap_bucket_number(F.col("s") + 1).alias("range"), F.bitmap_bit_position(F.col("s") + 1).alias("bit"))
    marks = np.zeros(slots, dtype=np.uint8)
    for r in ranges.groupBy("range").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8), bitorder="little")
        marks[np.flatnonzero(bits) + (r["range"] - 1) * len(bits)] = 1
    return F.lit(marks.tobytes())


def marked(marks: Column, slot: Column) -> Column:
    return F.substring(marks, slot + 1, F.lit(1)) == F.lit(b"\x01")


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, hash, length, gram) of all windows of all items, each once an item; grams are joined by a space."""
    words = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    texts = F.transform(starts, lambda i: F.slice("words", i, F.col("length")))
    exploded = words.select("item", "length", F.explode(texts).alias("gram"))
    return exploded.select("item", F.xxhash64("gram").alias("hash"), "length", F.array_join("gram", " ").alias("gram")).distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """Find every occurrence of a benchmark window in every document.

    An item of fewer than ``window`` words, but not none, is one window.  Returns a row per input
    row with all its columns under ``doc`` (a struct, so clashing names do no harm) and
    ``n_words``, ``hit_words`` (word numbers from 0 under any occurrence, ascending), ``item_ids``
    (distinct, ascending as strings; items without an id mark words but aren't listed) and
    ``clean_text`` (the text without the hit words and the gaps before them).

    A null or wordless text has no words and no hits; a null id is as good as another; texts of any
    length are searched whole; ties and repeated rows give equal results, as everything depends on
    the row alone; empty tables give no rows or no hits.
    """
    owned = checkpoint(benchmark_windows(items, item_id, item_text, window))
    grams = checkpoint(owned.select("hash", "length", "gram").distinct())
    # an entry of the set has its text and some 64 bytes around it
    size = grams.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + 64).alias("bytes"), F.array_sort(F.collect_set("length")).alias("lengths")).first()
    known = F.broadcast(grams) if (size["bytes"] or 0) <= BROADCAST_BYTES else grams
    slots, fits = slots_for(size["n"]), size["n"] * SLOTS_PER_WINDOW <= MOST_SLOTS
    split = F.split("gram", " ")
    first_marks = filled(slots, grams.select(slot_of(slots, F.xxhash64(split[0], F.get(split, F.lit(1))))))
    whole_marks = filled(slots, grams.select(F.explode(F.array(*probes_of(slots, F.col("hash"))))))

    # the same text under the same id has the same hits, so id and text hash stand for the row
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    own = F.col("doc").getField(doc_id)
    keyed = keyed.select("doc", F.coalesce(own.cast("string"), F.lit("")).alias("own"), own.isNull().alias("none"), F.xxhash64(F.col("doc").getField(text)).alias("body"))
    key = ["own", "none", "body"]
    split_up = keyed.select(*key, words_of(F.col("doc").getField(text)).alias("words"))

    def text_of(start: Column, length: Column | int) -> Column:
        return F.array_join(F.slice("words", start + 1, length), " ")

    def probe(k: int) -> Callable[[Column], Column]:
        return lambda w: marked(whole_marks, probes_of(slots, w["hash"])[k])

    def left_over(length: int) -> Column:
        """Of a document's windows of one length those that pass both filters; with their texts, if those are few."""
        count = F.size("words") - length + 1
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        second = (lambda i: F.get("words", i + 1)) if length > 1 else (lambda i: F.lit(None).cast("string"))
        begun = F.filter(starts, lambda i: marked(first_marks, slot_of(slots, F.xxhash64(F.get("words", i), second(i)))))
        passed = F.transform(begun, lambda i: F.struct(i.alias("start"), F.xxhash64(F.slice("words", i + 1, length)).alias("hash")))
        for k in range(PROBES):
            passed = F.filter(passed, probe(k))
        gram = (lambda w: text_of(w["start"], length)) if fits else (lambda w: F.lit(None).cast("string"))
        return F.transform(passed, lambda w: F.struct(w["start"].alias("start"), F.lit(length).alias("length"), w["hash"].alias("hash"), gram(w).alias("gram")))

    path = scratch(docs.sparkSession, "windows")
    none = F.array().cast("array<struct<start: int, length: int, hash: bigint, gram: string>>")
    windows = F.concat(none, *[left_over(n) for n in size["lengths"]])
    split_up.select(*key, F.size("words").cast("bigint").alias("n_words"), windows.alias("windows")).write.parquet(path)
    read = docs.sparkSession.read.parquet(path)

    met = read.where(F.size("windows") > 0).select(*key, F.explode("windows").alias("w")).select(*key, "w.*")
    if not fits:
        # the filters let too many through to carry their texts: the hashes meet first, and what is left gets its text
        few = met.join(grams.select("hash", "length").distinct(), ["hash", "length"], "left_semi").groupBy(*key).agg(F.collect_set(F.struct("start", "length", "hash")).alias("w"))
        texts = split_up.dropDuplicates(key).join(few, key).select(*key, F.transform("w", lambda w: F.struct(w["start"].alias("start"), w["length"].alias("length"), w["hash"].alias("hash"), text_of(w["start"], w["length"]).alias("gram"))).alias("w"))
        met = texts.select(*key, F.explode("w").alias("w")).select(*key, "w.*")
    agreed = scratch(docs.sparkSession, "hits")
    met.join(known, ["hash", "length", "gram"]).select(*key, "start", "length", "hash", "gram").distinct().write.parquet(agreed)
    hit = docs.sparkSession.read.parquet(agreed)

    # a window's items are brought to a document once, however often it stands there
    whose = hit.select(*key, "hash", "length", "gram").distinct().join(owned, ["hash", "length", "gram"]).select(*key, F.col("item").cast("string").alias("item"))
    listed = whose.where("item IS NOT NULL").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    hits = hit.groupBy(*key).agg(F.collect_list(F.struct("start", "length")).alias("hits"))
    covered = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
    hits = hits.select(*key, F.array_sort(F.array_distinct(covered)).alias("hit_words")).join(listed, key, "left")
    counts = read.groupBy(*key).agg(F.first("n_words").alias("n_words"))
    found = keyed.join(counts.join(hits, key, "left"), key)
    found = found.select(
        "doc", "n_words", F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )
    return found.withColumn("clean_text", without_words(F.col("doc").getField(text), F.col("hit_words")))


def without_words(text: Column, hit_words: Column) -> Column:
    """The text less the numbered words and the gaps before them; as it is where none is numbered."""
    words, gaps = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.split(text, RAW_WORD)
    kept = F.filter(F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda a, b: F.concat(a, b)), lambda _, i: ~F.array_contains(hit_words, i))
    return F.when(F.size(hit_words) == 0, text).otherwise(F.concat(F.array_join(kept, ""), F.get(gaps, F.size(words))))
