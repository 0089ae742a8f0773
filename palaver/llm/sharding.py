"""Sharding by a Hilbert curve over quantised metadata.

Main path: DataFrame functions only.  The metadata columns become small integers (equal-depth
bins), the bins' cell gets its index on a Hilbert curve, rows are ranked along the curve, and the
ranking is cut into runs of equal row counts.  Neighbouring cells share most of their bins, so a
shard's files have narrow ranges in every dimension and a filter on any of them prunes files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import checkpoint

#: Rows of one ranking group: at least and at most so many.
LEAST_GROUP, MOST_GROUP = 32, 50_000


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


#: Distinct values of a text dimension whose counts are added up on the driver.
FEW_VALUES = 10_000


def all_text_bounds(rows: DataFrame, columns: list[str], bins: int) -> dict[str, list[str]]:
    """The values at which the bins of each text column end, each with about as many rows, by counts of all whole values.

    All columns are counted in one pass; those of more than FEW_VALUES values are added up in ranges.
    """
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in columns]))
    counts = rows.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("of", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(FEW_VALUES + 1).collect()
    if len(few) > FEW_VALUES:
        return {c: text_bounds(rows, c, bins) for c in columns}
    out = {}
    for c in columns:
        own = sorted((r["value"], r["n"]) for r in few if r["of"] == c)
        total, up_to, last = sum(n for _, n in own), 0, {}
        for value, n in own:
            up_to += n
            last[(up_to - 1) * bins // total] = value
        out[c] = list(last.values())[:-1]
    return out


def text_bounds(rows: DataFrame, column: str, bins: int) -> list[str]:
    """The same for a column of any number of values: sorted in ranges, a range's counts are summed up within it, and
    begin where the sum of the ranges before it ends."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    counts = checkpoint(counts.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    sums = counts.groupBy("part").agg(F.sum("n").alias("in_part"))
    sums = sums.withColumn("before", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part"))  # a row for each range
    total = sums.agg(F.sum("in_part")).first()[0] or 0
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    binned = counts.join(sums, "part").select(column, F.floor((up_to - 1) * bins / F.lit(max(total, 1))).alias("bin"))
    return sorted(r["last"] for r in binned.groupBy("bin").agg(F.max(column).alias("last")).collect())[:-1]  # a row for each bin


def equal_depth_bin(code: Column, bounds: list) -> Column:
    """How many bounds lie below the value; null is in bin 0."""
    over = reduce(lambda a, b: a + b, [(code > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    return F.coalesce(over, F.lit(0))


def hilbert_index(bins: list[str], bits: int) -> Column:
    """Index on the Hilbert curve of ``len(bins)`` dimensions with ``bits`` bits each.

    The axes are turned into the transposed index from the highest bit down (Skilling 2004): per
    bit and axis either the low bits of axis 0 are inverted or exchanged with the axis; then the
    Gray code is undone and the bits are interleaved.  All of it is array functions.
    """
    n = len(bins)
    axes = F.array(*[F.col(c).cast("bigint") for c in bins])

    def bit(value: Column, level: int) -> Column:
        return F.shiftright(value, level).bitwiseAND(F.lit(1))

    def per_axis(state: Column, i: int, level: int) -> Column:
        low = F.lit((1 << level) - 1).cast("bigint")
        first, own = state[0], state[i]
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = bit(own, level) == 1
        new_first = F.when(inverted, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(inverted, own).otherwise(own.bitwiseXOR(swap))
        parts = [new_first if j == 0 else new_own if j == i else state[j] for j in range(n)]
        if i == 0:
            parts[0] = F.when(inverted, first.bitwiseXOR(low)).otherwise(first)
        return F.array(*parts)

    # each step is one lambda of aggregate(), so that no expression is repeated in the next one
    def step(state: Column, i: int, level: int) -> Column:
        return F.aggregate(F.array(F.lit(0)), state, lambda s, _: per_axis(s, i, level))

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            axes = step(axes, i, level)

    def gray(state: Column) -> Column:
        parts = [state[0]]
        for j in range(1, n):
            parts.append(state[j].bitwiseXOR(parts[-1]))
        turn = F.lit(0).cast("bigint")
        for level in range(bits - 1, 0, -1):
            turn = turn.bitwiseXOR(F.when(bit(parts[-1], level) == 1, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
        return F.array(*[p.bitwiseXOR(turn) for p in parts])

    axes = F.aggregate(F.array(F.lit(0)), axes, lambda s, _: gray(s))

    def interleave(state: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for level in range(bits - 1, -1, -1):
            for j in range(n):
                out = F.shiftleft(out, 1).bitwiseOR(bit(state[j], level))
        return out

    return F.transform(F.array(axes), interleave)[0]


def hilbert_shards(docs: DataFrame, dimensions: list[str], key: str, text: str = "text", num_shards: int = 40, bits: int = 4) -> DataFrame:
    """Rank the rows of ``docs`` along the curve over ``dimensions`` and cut ``num_shards`` runs.

    Returns one row per input row: the key, the dimensions, ``size`` (UTF-8 bytes of the text, null
    none, plus 16), ``text_crc32`` (null text as ''), ``cell`` (curve index), ``rank`` (0 to n-1),
    ``shard`` and ``slot`` (0 to the shard's rows less one).  Law: row counts of any two shards
    differ by one at most.

    Nulls are in the lowest bin, null keys among them; of a text of any length only size and
    checksum are kept; an empty table gives no rows; repeated rows each get their own
    slot; columns besides those named are not looked at, so their names may clash with ours.
    A cell of any share of the rows is divided into groups by a hash of key and text, sized by the
    row count, so that no task ranks more than one group.
    """
    if bits * len(dimensions) > 16:
        raise ValueError("the curve has more than 65,536 cells; use fewer bits or dimensions")
    kinds = dict(docs.dtypes)
    codes = [f"c{i}" for i in range(len(dimensions))]
    number = {c: kinds[d] in NUMBERS or kinds[d].startswith("decimal") for d, c in zip(dimensions, codes, strict=True)}
    slim = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        *[F.col(d).cast("double" if number[c] else "string").alias(c) for d, c in zip(dimensions, codes, strict=True)],
    )
    slim = checkpoint(slim)
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = slim.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, share, 1000).alias(c) for c in codes if number[c]]).first().asDict()
    n = bounds["n"]
    bounds.update(all_text_bounds(slim, [c for c in codes if not number[c]], 1 << bits))
    binned = slim.select("key", "size", "text_crc32", *[equal_depth_bin(F.col(c), sorted(set(bounds[c] or []))).alias(c) for c in codes])

    # at most 2^(bits * dimensions) cells, whatever the number of rows
    target = min(max(n // 4096, LEAST_GROUP), MOST_GROUP)
    cells = (
        binned.groupBy(*codes)
        .agg(F.count(F.lit(1)).alias("in_cell"))
        .select(*codes, hilbert_index(codes, bits).alias("cell"), F.ceil(F.col("in_cell") / F.lit(target)).cast("bigint").alias("parts"))
    )
    cells = checkpoint(cells)
    placed = binned.join(F.broadcast(cells), codes).select(
        "key", "size", "text_crc32", "cell", F.pmod(F.xxhash64("key", "text_crc32"), F.col("parts")).alias("part")
    )
    groups = placed.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("in_group"))
    before = F.sum("in_group").over(Window.orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("cell", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inner = Window.partitionBy("cell", "part").orderBy("text_crc32", "key", "size")
    ranked = placed.withColumn("nth", F.row_number().over(inner) - 1).join(groups, ["cell", "part"])
    rank = F.col("before") + F.col("nth")
    shard = F.expr(f"(before + nth) * {num_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {num_shards - 1}) div {num_shards}")
    return (
        ranked.select(F.col("key").alias(key), "size", "text_crc32", "cell", rank.alias("rank"), shard.cast("int").alias("shard"))
        .withColumn("slot", (F.col("rank") - first).cast("bigint"))
    )


def write_shards(docs: DataFrame, placed: DataFrame, key: str, path: str, text: str = "text") -> None:
    """Write ``docs`` in the order of ``placed`` (made of the same rows), one folder per shard, with ``slot``.

    Rows find their places by key, size and crc32 of the text, and rows that agree in these, such as
    repeated ones, by a number among them; null keys are keys like others.
    """
    same = ["_none", "_key", "_size", "_crc"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("_tie"))
    own = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key")
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("bigint").alias("_size")
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("_crc")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).isNull().alias("_none"), own, size, crc, F.xxhash64(text).alias("_tie"))
    places = placed.select(F.col(key).isNull().alias("_none"), own, F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.struct("shard", "slot").alias("_tie"), "shard", "slot")
    both = rows.withColumn("_nth", nth).join(places.withColumn("_nth", nth).drop("_tie"), [*same, "_nth"])
    out = both.select("_row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    out.write.partitionBy("_shard").parquet(path)
