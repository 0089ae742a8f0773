"""Scans of the message index: scope, visibility, recency, keys, top-k lists, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids up to this many are an IN list; more come as a table and an anti join.
INLINE_IDS = 200


def in_scope(rows: DataFrame, guild: object = None, channel: object = None, cross_channel: bool = False, guild_col: str = "guild_id", channel_col: str = "channel_id") -> DataFrame:
    """The whole guild if that is wanted and known, else one channel."""
    if cross_channel and guild is not None:
        return rows.where(F.col(guild_col) == F.lit(guild))
    return rows.where(F.col(channel_col) == F.lit(channel))


def excluding(rows: DataFrame, ids: DataFrame | list, key: str) -> DataFrame:
    """Rows whose key isn't among ``ids``; null keys stay."""
    if isinstance(ids, list):
        if len(ids) <= INLINE_IDS:
            return rows.where(~F.col(key).isin(ids) | F.col(key).isNull()) if ids else rows
        ids = rows.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` {rows.schema[key].dataType.simpleString()}")
    return rows.join(ids.select(ids.columns[0]).toDF(key), key, "left_anti")


def visible(rows: DataFrame, hidden: str = "hidden", deleted_at: str = "deleted_at") -> DataFrame:
    return rows.where(~F.col(hidden) & F.col(deleted_at).isNull())


def visible_by_marks(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Rows without a mark in a table of hidden keys."""
    return rows.join(marks.select(key), key, "left_anti")


def since(rows: DataFrame, at: str, as_of: Column, hours: float) -> DataFrame:
    return rows.where(F.col(at) >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))


def humans_and(rows: DataFrame, own_bot: int | None, is_bot: str = "is_bot", author: str = "author_id") -> DataFrame:
    """Rows of people, and of one's own bot where it is named."""
    keep = ~F.col(is_bot)
    return rows.where(keep | (F.col(author) == F.lit(own_bot)) if own_bot is not None else keep)


def recent(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The newest rows, later keys first among equals: a top-k without a full sort."""
    return rows.orderBy(F.col(at).desc_nulls_last(), F.col(key).desc()).limit(most)


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(ids.columns[0]).toDF(key).distinct(), key, "left_semi")


def bounded(wanted: int, least: int = 1, most: int = 500) -> int:
    return min(max(wanted, least), most)


def pending_embeddings(index: DataFrame, embeddings: DataFrame, model: str, as_of: Column, most: int) -> DataFrame:
    """Visible messages whose vector is due, newest first, with the text to embed and the content's hash."""
    due = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)))
    rows = visible(index).join(due.select("message_id", "content_hash"), "message_id")
    sent = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss") if dict(index.dtypes)["created_at"].startswith("timestamp") else F.col("created_at").cast("string")
    # fixed value: the form in which texts are embedded
    text = F.concat(F.lit("title: Discord message by "), F.coalesce("author_name", F.lit("")), F.lit(" at "), F.coalesce(sent, F.lit("")), F.lit(" | text: "), "content_text")
    return recent(rows, "created_at", "message_id", most).select("message_id", text.alias("document"), "content_hash")


def status_counts(index: DataFrame, embeddings: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """All messages, and those whose vector is done, pending or failed, in one pass over the join."""
    joined = index.join(embeddings.select(key, "embedding_status"), key, "left")
    counts = [F.count_if(F.col("embedding_status") == s).alias(s) for s in ("done", "pending", "failed")]
    return joined.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *counts)


def hideable(rows: DataFrame, at: str, key: str, text: str, history: int, wanted: int = 10) -> DataFrame:
    """The newest own messages with real content, at most ``wanted`` among the last ones scanned."""
    scanned = recent(rows, at, key, min(max(250, wanted * 10), max(history, wanted)))
    return recent(scanned.where((F.col(text) != "") & (F.col(text) != ".")), at, key, wanted)


def complete(names: DataFrame, name: str, typed: str, most: int = 25) -> DataFrame:
    """Autocomplete: names that hold the typed text, with a title-case label."""
    found = names.where(F.lower(F.col(name)).contains(typed.lower())).select(name).distinct()
    return found.orderBy(name).limit(most).select(F.initcap(F.translate(name, "_", " ")).alias("label"), F.col(name).alias("value"))


def not_stale(rows: DataFrame, at: str, as_of: Column, seconds: int = 300) -> DataFrame:
    """Rows that aren't older than ``seconds``: what a sweep leaves."""
    return rows.where(F.col(at) >= as_of - F.expr(f"INTERVAL {seconds} SECONDS"))


def looked_up(keys: DataFrame, state: DataFrame, by: list[str], defaults: dict[str, object]) -> DataFrame:
    """Each key's columns of a state table; a key that it doesn't have, or a null there, gets the default."""
    found = keys.join(state.select(*by, *defaults), by, "left")
    return found.select(*keys.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def chronological(rows: DataFrame, at: str, key: str) -> DataFrame:
    """Oldest first; rows of one time by key, those without a time first."""
    return rows.orderBy(F.asc_nulls_first(at), F.asc(key))
