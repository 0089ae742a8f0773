"""Ordered scans over groups of any size: a group of very many rows is dealt to chunks that follow each other.

A window function puts a whole group into one task.  Here groups of at most ``most`` rows stay that
way; the rows of larger ones are dealt by bounds of their order, drawn from a sample of a fixed rate,
to chunks of about ``most`` rows.  Each chunk is scanned on its own, and what it must know of those
before it (how many rows, their last time, how many sessions) is carried over a table that has one
row a chunk.  Results don't depend on where the bounds lie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import checkpoint

#: Rows of a group beyond which it is dealt to several tasks, and sampled rows for each of its chunks.
MOST, SAMPLES = 1_000_000, 16


@dataclass
class Dealt:
    """Rows of groups that are one task each, and those of large groups, with ``_chunk`` and ``_key`` (their order)."""

    small: DataFrame
    large: DataFrame | None


def _beside(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the other columns of a small table of one row a key; null keys are equal."""
    named = table.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(F.broadcast(named), on, how).drop(*[f"_of_{k}" for k in keys])


def dealt(rows: DataFrame, by: list[str], order: list[Column | str], most: int = MOST) -> Dealt:
    """Split rows by the size of their groups, and deal the large ones; ``order`` is ascending.

    There are at most as many large groups as ``most`` goes into the rows, and about as many bounds:
    that is what is broadcast.  Rows of equal order stay in one chunk.
    """
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*by)
    if counts.isEmpty():
        return Dealt(rows, None)
    large = checkpoint(counts)
    key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    small, hot = _beside(rows, large, by, "left_anti"), _beside(rows, large, by, "left_semi").withColumn("_key", key)
    rate = max(1, most // SAMPLES)
    # every row may be drawn, whatever its order and group; which ones are hangs on the rows alone
    drawn = hot.where(F.pmod(F.xxhash64("_key", *by), F.lit(rate)) == 0)
    listed = drawn.groupBy(*by).agg(F.array_sort(F.collect_set("_key")).alias("s"))
    bounds = listed.select(*by, F.filter("s", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("_bounds")).withColumn("_step", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_bounds"))).cast("int")))
    bounds = checkpoint(bounds.withColumn("_coarse", F.expr("filter(_bounds, (x, i) -> (i + 1) % _step = 0)")))
    known = _beside(hot, bounds, by)
    # the number of bounds before a row: first among every n-th of them, then among those between two
    rough = known.withColumn("_rough", F.expr("size(filter(_coarse, x -> x < _key)) * _step"))
    placed = rough.withColumn("_chunk", F.expr("coalesce(_rough + size(filter(slice(_bounds, _rough + 1, _step), x -> x < _key)), 0)"))
    return Dealt(small, placed.drop("_bounds", "_step", "_coarse", "_rough"))


def _carried(chunks: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """A table of one row a chunk with aggregates over the chunks before it."""
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(*by, "_chunk", *[c.over(before).alias(n) for n, c in sums.items()])


def _window(by: list[str], order: list[Column | str]):
    return Window.partitionBy(*by, "_chunk").orderBy(*order)


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rn", most: int = MOST) -> DataFrame:
    """Rows numbered from 1 within their group; without ``by`` the whole table is one group."""
    if not by:
        return numbered(rows.withColumn("_all", F.lit(0)), ["_all"], order, name, most).drop("_all")
    parts = dealt(rows, by, order, most)
    small = parts.small.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    if parts.large is None:
        return small
    counts = parts.large.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    carry = _carried(counts, by, _before=F.sum("_n"))
    large = _beside(parts.large, carry, [*by, "_chunk"]).withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(_window(by, order)))
    return small.unionByName(large.drop("_before", "_chunk", "_key"))


def running(rows: DataFrame, by: list[str], order: list[Column | str], counted: Column, name: str, most: int = MOST) -> DataFrame:
    """Each row with how many rows of its group, of those that are counted, stand up to it."""
    parts = dealt(rows, by, order, most)
    one, upto = counted.cast("bigint"), (Window.unboundedPreceding, 0)
    small = parts.small.withColumn(name, F.sum(one).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)))
    if parts.large is None:
        return small
    totals = parts.large.groupBy(*by, "_chunk").agg(F.count_if(counted).alias("_n"))
    carried = _beside(parts.large, _carried(totals, by, _before=F.sum("_n")), [*by, "_chunk"])
    large = carried.withColumn(name, F.sum(one).over(_window(by, order).rowsBetween(*upto)) + F.coalesce("_before", F.lit(0)))
    return small.unionByName(large.drop("_before", "_chunk", "_key"))


def sessions(rows: DataFrame, by: list[str], at: str, key: str, gap_seconds: float, name: str = "session", most: int = MOST) -> DataFrame:
    """Each row's session number from 1: a new one after a gap longer than ``gap_seconds``."""
    order = [F.col(at), F.col(key)]
    time = F.unix_micros(F.col(at).cast("timestamp"))

    def begins(before: Column) -> Column:
        return F.when(before.isNull() | (time - before > int(gap_seconds * 1_000_000)), 1).otherwise(0)

    parts = dealt(rows, by, order, most)
    w = Window.partitionBy(*by).orderBy(*order)
    small = parts.small.withColumn("_begins", begins(F.lag(time).over(w))).withColumn(name, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")
    if parts.large is None:
        return small
    last = parts.large.groupBy(*by, "_chunk").agg(F.max(time).alias("_last"))
    known = _beside(parts.large, _carried(last, by, _seen=F.max("_last")), [*by, "_chunk"])
    w = _window(by, order)
    own = checkpoint(known.withColumn("_begins", begins(F.coalesce(F.lag(time).over(w), "_seen"))).withColumn("_own", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    totals = own.groupBy(*by, "_chunk").agg(F.max("_own").alias("_n"))
    large = _beside(own, _carried(totals, by, _earlier=F.sum("_n")), [*by, "_chunk"]).withColumn(name, F.col("_own") + F.coalesce("_earlier", F.lit(0)))
    return small.unionByName(large.drop("_begins", "_own", "_earlier", "_seen", "_chunk", "_key"))


def within(rows: DataFrame, by: list[str], at: str, seconds: int, name: str, most: int = MOST) -> DataFrame:
    """How many rows of the group lie within the last ``seconds``, both ends included.

    In a large group a row's number is a difference of two running counts, of the rows up to its own
    time and of those before its window: each row asks twice, and its second question may fall into
    any chunk, however long the window is.
    """
    time = F.unix_micros(F.col(at).cast("timestamp"))
    parts = dealt(rows, by, [time], most)
    small = parts.small.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(time).rangeBetween(-seconds * 1_000_000, 0)))
    if parts.large is None:
        return small
    whole = checkpoint(parts.large.drop("_key", "_chunk").withColumn("_id", F.monotonically_increasing_id()).withColumn("_t", time))
    # 0 asks before the rows of its time (1) are counted, 2 after them
    marks = F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("_t") - shift).alias("u")) for kind, shift in ((0, seconds * 1_000_000), (1, 0), (2, 0))])
    asked = whole.select(*by, "_id", F.inline(marks))
    again = dealt(asked, by, [F.col("u"), F.col("kind")], most)
    counted = F.col("kind") == 1
    w = Window.partitionBy(*by).orderBy("u", "kind").rowsBetween(Window.unboundedPreceding, 0)
    running = again.small.withColumn("_sum", F.sum(counted.cast("bigint")).over(w))
    if again.large is not None:
        totals = again.large.groupBy(*by, "_chunk").agg(F.count_if(counted).alias("_n"))
        carried = _beside(again.large, _carried(totals, by, _before=F.sum("_n")), [*by, "_chunk"])
        own = F.sum(counted.cast("bigint")).over(_window(by, [F.col("u"), F.col("kind")]).rowsBetween(Window.unboundedPreceding, 0))
        running = running.unionByName(carried.withColumn("_sum", own + F.coalesce("_before", F.lit(0))).drop("_before", "_chunk", "_key"))
    found = running.where("kind <> 1").groupBy("_id").agg(F.sum(F.when(F.col("kind") == 2, F.col("_sum")).otherwise(-F.col("_sum"))).alias(name))
    return small.unionByName(whole.join(found, "_id").drop("_id", "_t"))


def rolling(rows: DataFrame, by: list[str], order: list[Column | str], value: str, size: int, name: str, most: int = MOST) -> DataFrame:
    """Each row with the list of the last ``size`` values of its group, itself included.

    A chunk is lent the ``size - 1`` rows before it, from whatever chunks they lie in.
    """
    parts = dealt(rows, by, order, most)
    small = parts.small.withColumn(name, F.collect_list(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)))
    if parts.large is None:
        return small
    counts = parts.large.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    carry = checkpoint(_carried(counts, by, _before=F.sum("_n")).fillna(0, ["_before"]))
    own = checkpoint(_beside(parts.large, carry, [*by, "_chunk"]).withColumn("_rn", F.col("_before") + F.row_number().over(_window(by, order))).withColumn("_lent", F.lit(False)))
    if size > 1:
        lent = carry.where("_before > 0").select(*by, F.col("_chunk").alias("_to"), F.explode(F.sequence(F.greatest(F.lit(1).cast("bigint"), F.col("_before") - (size - 2)), F.col("_before"))).alias("_rn"))
        # a row may be lent to several chunks, where chunks are shorter than the list
        copies = _beside(own, lent.groupBy(*by, "_rn").agg(F.collect_list("_to").alias("_tos")), [*by, "_rn"], "inner")
        moved = copies.withColumn("_chunk", F.explode("_tos")).drop("_tos").withColumn("_lent", F.lit(True))
        own = own.unionByName(moved)
    listed = own.withColumn(name, F.collect_list(value).over(Window.partitionBy(*by, "_chunk").orderBy("_rn").rowsBetween(1 - size, 0)))
    return small.unionByName(listed.where(~F.col("_lent")).drop("_before", "_rn", "_lent", "_chunk", "_key"))
