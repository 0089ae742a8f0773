"""SimHash near-duplicates over a byte-position inverted index with count filtering.

The first part finds all fingerprints within a few bits; the second groups texts of a given
similarity by longer fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import checkpoint, give_back, text_slices, with_text
from palaver.llm.graph import connected_components, forest

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words (all of a shorter text; none of an empty one)."""
    own = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(own) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(own), SEED)] if own else []
    joined = b" ".join(own)
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])[: len(own) - words + 1].tolist()
    ends = np.concatenate([spaces, [len(joined)]])[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bit k is 1 if it is set in over half of the hashes; 0 without hashes."""
    bits, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4) -> DataFrame:
    """(doc struct of all columns, fp long) for every row; null counts as empty."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(with_text(batches, text), 1):
            fps = [fingerprint(shingle_hashes(t or "", words)) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps, pa.int64())], names=["doc", "fp"])

    return whole.mapInArrow(hashed, f"doc {whole.schema['doc'].dataType.simpleString()}, fp long")


# Two fingerprints that differ in at most 4 bits share at least 4 of their 8 bytes: each bit spoils
# one byte.  Single bytes make posting lists of a 256th of the corpus each, so the index is keyed by
# byte triples, or fours where there are very many: the blocks below are chosen such that any 4 shared
# positions hold one whole block.
POSITIONS, DISTANCE, BLOCK = 8, 4, 3
#: Fingerprints under one key that are compared at once; more are dealt to pairs of parts.
MOST_UNDER_KEY = 4096
#: Postings that a task compares at once.
CHUNK = 200_000


def covering_blocks(points: int = POSITIONS, guaranteed: int = POSITIONS - DISTANCE, size: int = BLOCK) -> list[tuple[int, ...]]:
    """Blocks such that each set of ``guaranteed`` positions holds one: few, by Turan's construction.

    The positions are dealt to three classes; triples within a class, or of two positions of one
    class and one of the next, meet every four positions (checked by the tests).
    """
    from itertools import combinations

    if (guaranteed, size) != (4, 3):
        return list(combinations(range(points), size))
    kind = [p % 3 for p in range(points)]

    def taken(block: tuple[int, ...]) -> bool:
        counts = [sum(kind[p] == k for p in block) for k in range(3)]
        return 3 in counts or any(counts[k] == 2 and counts[(k + 1) % 3] == 1 for k in range(3))

    return [b for b in combinations(range(points), size) if taken(b)]


def block_size(fingerprints: int) -> int:
    """Three bytes to a key, or four where so many fingerprints would meet under three that the more postings of four are fewer steps."""
    steps = {size: len(covering_blocks(size=size)) * (1 + fingerprints / 256**size) for size in (BLOCK, BLOCK + 1)}
    return min(steps, key=steps.__getitem__)


def byte_at(fp: str, position: int):
    return F.shiftrightunsigned(F.col(fp), 8 * position).bitwiseAND(F.lit(255))


def index_keys(fps: DataFrame, blocks: list[tuple[int, ...]]) -> DataFrame:
    """(fp, block, key) postings: the number of the block and the bytes at its positions."""
    keys = []
    for n, block in enumerate(blocks):
        key = F.lit(n).cast("bigint")
        for p in block:
            key = F.shiftleft(key, 8).bitwiseOR(byte_at("fp", p))
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of each pair: positions at which both have the same byte."""
    return ((a ^ b).view(np.uint8).reshape(len(a), -1) == 0).sum(axis=1)


def grouped(postings: DataFrame, names: list[str]) -> DataFrame:
    """Postings (key, node, *names) as (g, node, *names), sorted by group within partitions.

    A group is a key; the nodes of a frequent key are dealt to parts, and every two parts are a group
    of their own, numbered by a hash.  Groups that share a number are compared as one, which adds
    comparisons and no links.
    """
    half = MOST_UNDER_KEY // 2
    hot = checkpoint(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_UNDER_KEY))
    hot = hot.select("key", F.ceil(F.col("n") / half).alias("g"))
    dealt = postings.join(hot, "key", "left").withColumn("b", F.pmod(F.xxhash64("node"), F.col("g")))
    others = F.when(F.col("g").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1))
    dealt = dealt.select("*", F.explode(others).alias("o")).where("g IS NULL OR b != o")
    number = F.when(F.col("g").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")))
    return dealt.select(number.alias("g"), "node", *names).repartition("g").sortWithinPartitions("g")


def compared(postings: DataFrame, words: int, most: int, least_shared: int) -> DataFrame:
    """Links (u, v) between the nodes of each key: a forest of those with enough shared bytes and at most ``most`` differing bits.

    ``postings``: key, node long, and fingerprints in w0, w1, ...; the forest has the components of
    all such pairs, and no pair leaves a task.
    """
    return grouped(postings, [f"w{k}" for k in range(words)]).mapInArrow(_near_forest(words, most, least_shared), "u long, v long")


def _by_groups(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    """``found`` of whole groups of sorted rows (g, ...), about CHUNK rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            group = table.column(0).to_numpy()
            whole = np.flatnonzero(group != group[-1])
            cut = int(whole[-1]) + 1 if len(whole) else 0  # the last group may go on
            yield found(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield found(pa.Table.from_batches(held))
    give_back()


def _near_pairs(table: pa.Table, words: int, most: int, least_shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of the pairs of a group that are near enough, those of one distance between places at a time."""
    group = table.column(0).to_numpy()
    fps = np.stack([table.column(2 + k).to_numpy().view(np.uint64) for k in range(words)], axis=1)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(group))  # rows of the group from here on
    step, first = 1, np.arange(len(group))
    while len(first := first[left[first] > step]):
        near = first
        if least_shared:
            near = near[shared_bytes(fps[near], fps[near + step]) >= least_shared]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]).sum(axis=1) <= most]
        yield near, near + step
        step += 1


def _near_forest(words: int, most: int, least_shared: int):
    def found(table: pa.Table) -> pa.RecordBatch:
        node = table.column(1).to_numpy()
        pairs = [(node[:0], node[:0])] + [(node[a], node[b]) for a, b in _near_pairs(table, words, most, least_shared)]
        u, v = forest(*(np.concatenate([p[k] for p in pairs]) for k in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return lambda batches: _by_groups(batches, found)


def _with_partner(words: int, most: int):
    """Of each group the rows (g, node) that are near enough to another one of it."""

    def found(table: pa.Table) -> pa.RecordBatch:
        keep = np.zeros(table.num_rows, dtype=bool)
        for a, b in _near_pairs(table, words, most, 0):
            keep[a] = keep[b] = True
        group, node = table.column(0).to_numpy()[keep], table.column(1).to_numpy()[keep]
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(node)], names=["g", "node"])

    return lambda batches: _by_groups(batches, found)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints: their components are those of Hamming distance <= 4.

    Candidates share a key of the index; their shared bytes are tallied, and pairs with the
    guaranteed 4 are verified bit by bit.  The links are the same with blocks of either size.
    """
    postings = index_keys(fps, covering_blocks(size=block_size(fps.count()))).select("key", F.col("fp").alias("node"), F.col("fp").alias("w0"))
    return compared(postings, 1, DISTANCE, POSITIONS - DISTANCE)


def fingerprint_groups(rows: DataFrame) -> DataFrame:
    """(fp, first_id, component_id) for each fingerprint of rows (doc_id, fp)."""
    own = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = checkpoint(connected_components(near_links(own.select("fp"))).withColumnRenamed("node", "fp"))
    linked = parts.join(own, "fp")
    least = checkpoint(linked.groupBy("component").agg(F.min("first_id").alias("least_id"), F.min_by("fp", F.coalesce("first_id", F.lit((1 << 63) - 1))).alias("least_fp")))
    named = checkpoint(parts.join(least, "component").select("fp", "least_id", "least_fp"))
    joined = own.join(named, "fp", "left")
    return checkpoint(joined.select("fp", "first_id", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("least_fp", "fp").alias("kept_fp")))


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id: the smallest doc_id reachable by links.

    Rows of one fingerprint are linked with each other, so copies of any number are one node.
    Null texts count as empty, texts without words have fingerprint 0; rows without a doc_id take
    part, and the smallest id that isn't null names the component (null if none has one); repeated
    rows stay; texts of any length are hashed whole, one at a time where they are long; an empty
    table gives no rows; other columns are not read.
    """
    rows = checkpoint(fingerprints(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "text", words).select("doc.doc_id", "fp"))
    groups = fingerprint_groups(rows)
    return rows.join(groups, "fp").select(F.col("doc_id").alias(doc_id), "fp", "component_id")


# ---- groups of a given similarity --------------------------------------------------------------
#
# At a similarity of 0.8 about 15 % of the bits differ, more than one in each byte: no number of
# shared bytes is guaranteed then.  Fingerprints are therefore eight times as long.  Pairs are
# candidates under random blocks of their bytes, as many as make a pair at that similarity meet with
# the probability MEET; a quarter of the bits goes with each posting, and the rows of a block that
# are about near another one by these get all bits, which verify the pair.

WORDS_OF_FP, CARRIED, MEET = 8, 2, 0.985
#: Standard deviations above the expected number of differing bits that a pair may have, of all bits and of those carried.
DEVIATIONS, CARRIED_DEVIATIONS = 1.5, 3.5
FACTORS = np.random.default_rng(8).integers(1 << 62, 1 << 63, WORDS_OF_FP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(hashes: list[int]) -> list[int]:
    """A fingerprint of 512 bits in eight numbers, from as many mixtures of each hash."""
    bits, n = np.zeros(64 * WORDS_OF_FP, dtype=np.int64), len(hashes)
    for at in range(0, n, 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype=np.uint64)[:, None] * FACTORS
        part ^= part >> np.uint64(32)
        part *= FACTORS[::-1]
        bits += np.unpackbits((part ^ part >> np.uint64(29)).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > n, bitorder="little").view("<i8").tolist()


def share_of_bits(similarity: float) -> float:
    """The expected share of differing bits at a Jaccard similarity of two sets of like size."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_bits(similarity: float, words: int = WORDS_OF_FP, deviations: float = DEVIATIONS) -> int:
    """Of the bits of so many words the number that is expected to differ, and some standard deviations."""
    p, n = share_of_bits(similarity), 64 * words
    return int(p * n + deviations * np.sqrt(n * p * (1 - p)))


def meeting(blocks: int, size: int, similarity: float) -> float:
    """The probability that two texts of a similarity agree in one of so many blocks: over the numbers of bytes that they share."""
    points, same = 8 * WORDS_OF_FP, (1 - share_of_bits(similarity)) ** 8
    shared = np.arange(points + 1)
    weight = np.array([math.comb(points, int(k)) * same**k * (1 - same) ** (points - k) for k in shared])
    inside = np.array([math.comb(int(k), size) / math.comb(points, size) for k in shared])
    return float((weight * (1 - (1 - inside) ** blocks)).sum())


def random_blocks(rows: int, similarity: float) -> list[tuple[int, ...]]:
    """Blocks of so many bytes that a key has about 256 other fingerprints at most, enough of them to meet at ``similarity``."""
    size = 2
    while 256 ** (size + 1) < rows:
        size += 1
    rng, points = np.random.default_rng(64), 8 * WORDS_OF_FP
    blocks: dict[tuple[int, ...], None] = {}
    while not blocks or meeting(len(blocks), size, similarity) < MEET:
        blocks[tuple(sorted(int(x) for x in rng.choice(points, size, replace=False)))] = None
    return list(blocks)


def similar_links(fps: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) with the components of all candidate pairs whose fingerprints differ in most_bits() at most.

    ``fps``: node long and w0 to w7, all different.
    """
    names, shown = [f"w{k}" for k in range(WORDS_OF_FP)], [f"w{k}" for k in range(CARRIED)]
    keys = []
    for number, block in enumerate(random_blocks(fps.count(), similarity)):
        key = F.lit(number).cast("bigint")
        for p in block:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(F.col(names[p // 8]), 8 * (p % 8)).bitwiseAND(F.lit(255)))
        keys.append(key)
    postings = fps.select("node", *shown, F.explode(F.array(*keys)).alias("key"))
    close = grouped(postings, shown).mapInArrow(_with_partner(CARRIED, most_bits(similarity, CARRIED, CARRIED_DEVIATIONS)), "g long, node long")
    whole = close.join(fps, "node").select("g", "node", *names).repartition("g").sortWithinPartitions("g")
    return whole.mapInArrow(_near_forest(WORDS_OF_FP, most_bits(similarity), 0), "u long, v long")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the smallest doc_id.

    Near copies are texts whose sets of shingles of ``words`` words have a Jaccard similarity of
    about ``similarity`` or more, judged by wide fingerprints; groups are the components of such
    links.  Null texts count as empty, texts of any length are read whole; rows without a doc_id
    come after the others of their group; of rows that share id and text one stays; an empty table
    gives no rows; all columns are kept, whatever their names.
    """
    names = [f"w{k}" for k in range(WORDS_OF_FP)]
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 2):
            fps = np.array([wide_fingerprint(shingle_hashes(t or "", words)) for t in rows.column(2).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(fps[:, k]) for k in range(WORDS_OF_FP))], names=["doc_id", "body", *names])

    rows = checkpoint(slim.mapInArrow(hashed, "doc_id long, body long, " + ", ".join(f"{n} long" for n in names)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("first")
    own = checkpoint(rows.groupBy(*names).agg(first).withColumn("node", F.monotonically_increasing_id()))
    parts = checkpoint(connected_components(similar_links(own.select("node", *names), similarity)))
    kept = own.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    kept = kept.select("first.none", F.coalesce("first.doc_id", F.lit(0)).alias("id"), "first.body")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mine = F.col("doc").getField(doc_id).cast("bigint")
    whole = whole.select("doc", mine.isNull().alias("none"), F.coalesce(mine, F.lit(0)).alias("id"), F.xxhash64(F.col("doc").getField(text)).alias("body"))
    key = ["none", "id", "body"]
    out = whole.join(kept, key, "left_semi")
    repeated = rows.groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates(key)
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
