"""Positional operators over conversations: neighbours, sessions, buffers, prefixes, ordinals.

Orders are ascending.  Conversations of very many rows are scanned in chunks (see ``scans``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators import scans


def neighbours(rows: DataFrame, anchors: DataFrame, by: str, key: str, order: list[Column], before: int, after: int, drop: Column | None = None) -> DataFrame:
    """(anchor, offset, row) within so many rows around each anchor of its conversation.

    Limits count all rows; rows that ``drop`` names are taken out afterwards, but for the anchor.
    Each place is exploded to the few places it can be near to, so the join is on equal places.
    """
    placed = scans.numbered(rows, [by], order)
    marked = placed.join(anchors.select(by, key), [by, key], "left_semi").select(by, F.col(key).alias("anchor"), F.col("rn").alias("anchor_rn"))
    reach = marked.select(by, "anchor", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"), "anchor_rn")
    near = reach.withColumn("rn", F.col("anchor_rn") + F.col("offset")).join(placed, [by, "rn"])
    return near.where(~drop | (F.col("offset") == 0)) if drop is not None else near


def sessions(rows: DataFrame, by: list[str], at: str, gap_seconds: int, key: str) -> DataFrame:
    """Each row's session number from 1: a new one after a gap longer than ``gap_seconds``."""
    return scans.sessions(rows, by, at, key, gap_seconds)


def session_tail(rows: DataFrame, by: list[str], at: str, key: str, gap_seconds: int = 86_400, most: int = 500) -> DataFrame:
    """The newest rows of each conversation back to its last long gap, ``most`` at most.

    The newest ones are taken first, by each task of its own rows, so that gaps are looked for among few.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(key))
    newest = rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)
    w = Window.partitionBy(*by).orderBy("back")
    gap = F.unix_micros(F.lag(at).over(w).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    marked = newest.withColumn("_gap", F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0))
    return marked.withColumn("_gaps", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_gaps = 0").drop("_gap", "_gaps")


def rolling_buffer(rows: DataFrame, by: list[str], order: list[Column], value: str, size: int = 12) -> DataFrame:
    """Each row with the buffer of the last ``size`` values of its conversation, itself included."""
    return scans.rolling(rows, by, order, value, size, "buffer")


def last_rows(rows: DataFrame, by: list[str], newest_first: list[Column], size: int) -> DataFrame:
    """Spark keeps ``size`` rows of a group in each task before they are brought together."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*newest_first))).where(F.col("rn") <= size)


def through_first(rows: DataFrame, by: list[str], order: list[Column], flag: Column) -> DataFrame:
    """Rows up to and including the first flagged one of each group; ``kept`` tells them from the rest."""
    place = F.struct(*order)
    first = rows.where(flag).groupBy(*by).agg(F.min(place).alias("_first")).select(*[F.col(k).alias(f"_of_{k}") for k in by], "_first")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by])
    return rows.join(first, on, "left").withColumn("kept", F.col("_first").isNull() | (place <= F.col("_first"))).drop("_first", *[f"_of_{k}" for k in by])


def sliding_count(rows: DataFrame, by: list[str], at: str, seconds: int) -> DataFrame:
    """Rows of the key within the last ``seconds``, both ends included."""
    return scans.within(rows, by, at, seconds, "in_window")


def ordinal_labels(rows: DataFrame, by: list[str], order: list[Column], prefix: str = "CTX_MSG_") -> DataFrame:
    """Labels by place within a group, of three digits at least."""
    number = F.col("_rn").cast("string")
    label = F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(3)), "0"))
    return scans.numbered(rows, by, order, "_rn").withColumn("label", label).drop("_rn")


def image_orders(images: DataFrame, context: DataFrame, by: str, key: str, order: list[Column], current: str, replied: str) -> DataFrame:
    """Images (by, key of their message, position, current, replied) with ``image_index`` and the place of their message.

    The place is the message's ordinal label in the context; else it is the current message, the
    one that is replied to, or none of the context.
    """
    labels = ordinal_labels(context, [by], order).select(by, key, "label")
    own = F.coalesce("label", F.when(F.col(key) == F.col(current), "CURRENT_USER_MESSAGE").when(F.col(key) == F.col(replied), "REPLIED_TO_MESSAGE").otherwise("NON_CONTEXT_MESSAGE"))
    index = F.row_number().over(Window.partitionBy(by).orderBy("position"))
    return images.join(labels, [by, key], "left").select(*images.columns, index.alias("image_index"), own.alias("source_message_order"))


def replied_to(rows: DataFrame, by: str, key: str, reference: str, columns: list[str]) -> DataFrame:
    """Rows with a reference, and the columns (as ``replied_*``) of the row that it names; one hop, null where there is none."""
    target = rows.select(by, F.col(key).alias(reference), *[F.col(c).alias(f"replied_{c}") for c in columns])
    return rows.where(F.col(reference).isNotNull()).join(target, [by, reference], "left")


def zip_padded(inputs: Column, vectors: Column) -> Column:
    """array<struct<input, vector>> by place; the shorter side is padded with null."""
    longest = F.greatest(F.size(inputs), F.size(vectors))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.get(inputs, i).alias("input"), F.get(vectors, i).alias("vector")))


def newest_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group, as an aggregate."""
    return rows.select(*by, F.struct(*order).alias("o"), F.struct(*rows.columns).alias("row")).groupBy(*by).agg(F.max_by("row", "o").alias("row")).select("row.*")
