"""Current state out of change logs: message upserts, keyed settings, statuses, vectors.

Tables are append-only logs of events with a sequence number; the state is an aggregate over each
key's events, so that it is the same however often and in which pieces the log is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import content_hash, embedding_retry_seconds, normalised
from palaver.operators import scans


def latest(rows: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.max_by(c, seq).alias(c) for c in columns])


def latest_given(rows: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """The last value given for each column on its own; null leaves a column untouched."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


#: What is kept of a message's events: each column can be merged with another log's, in any order and again.
FACTS = ["born", "given", "updated_seq", "last_hide", "hide_seq", "deleted_seq"]


def message_facts(log: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, *FACTS) of events (seq, op, key, *fields); the first field is the content, normalised.

    Empty content rejects an upsert.  ``given`` holds the fields of the last accepted one.
    """
    upsert = F.col("op") == "upsert"
    text = normalised(F.col(fields[0]))
    accepted = log.where(~upsert | F.coalesce(F.col(fields[0]).rlike(r"(?U)\S"), F.lit(False)))
    turned = F.col("op").isin("hide", "unhide")
    return accepted.select(
        key, F.when(upsert, F.col("seq")).alias("born"), F.when(upsert, F.struct(text.alias(fields[0]), *fields[1:])).alias("given"), F.when(upsert, F.col("seq")).alias("updated_seq"),
        F.when(turned, F.col("op") == "hide").alias("last_hide"), F.when(turned, F.col("seq")).alias("hide_seq"), F.when(F.col("op") == "delete", F.col("seq")).alias("deleted_seq"),
    ).groupBy(key).agg(*merged_facts())


def merged_facts() -> list[Column]:
    """The aggregates that make one row of facts out of several; a fact that is met twice counts once."""
    return [
        F.min("born").alias("born"), F.max_by("given", "updated_seq").alias("given"), F.max("updated_seq").alias("updated_seq"),
        F.max_by("last_hide", "hide_seq").alias("last_hide"), F.max("hide_seq").alias("hide_seq"), F.max("deleted_seq").alias("deleted_seq"),
    ]


def deleted_by() -> Column:
    """Deleted, of facts; the last event of each kind is after the first upsert if any of that kind is."""
    return F.coalesce(F.col("deleted_seq") > F.col("born"), F.lit(False))


def hidden_by() -> Column:
    """Hidden, of facts: the last hide or unhide counts, a later deletion hides."""
    unhidden_later = F.col("hide_seq") > F.coalesce("deleted_seq", F.lit(-1))
    return F.coalesce(F.when((F.col("hide_seq") > F.col("born")) & (~deleted_by() | unhidden_later), F.col("last_hide")).otherwise(deleted_by()), F.lit(False))


def state_of(facts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Facts as message state; keys without an accepted upsert are no messages."""
    text = F.col("given").getField(fields[0])
    more = [F.col("given").getField(f).alias(f) for f in fields[1:]]
    return facts.where("born IS NOT NULL").select(key, text.alias("content_text"), *more, content_hash(text).alias("content_hash"), "updated_seq", hidden_by().alias("hidden"), deleted_by().alias("deleted"))


def message_state(log: DataFrame, key: str = "message_id") -> DataFrame:
    """Fold of (seq, op, key, content, ts): op is upsert, hide, unhide or delete.

    Empty content rejects an upsert.  Events before a key's first accepted upsert have no effect.
    A deletion is final (later upserts refresh columns but don't bring the message back) and
    hides; else the last hide or unhide counts, whatever upserts follow.
    """
    return state_of(message_facts(log, key, ["content"]), key, ["content"])


#: Failures after which a vector isn't tried again.
MOST_ATTEMPTS = 3


def embedding_state(log: DataFrame, key: str = "message_id") -> DataFrame:
    """State of each key's vector out of (seq, op, key, hash, at, error): op is content, ok or fail.

    New content resets to pending; ok counts only for the hash in force, fail for any; each fail
    since the last reset or ok adds an attempt, the third is final.  A key that isn't given up has
    ``next_retry_at``: a minute after the first failure, twice as long after each, an hour at most.
    """
    at_key = Window.partitionBy(key)
    w = at_key.orderBy("seq")
    content, ok, fail = F.col("op") == "content", F.col("op") == "ok", F.col("op") == "fail"
    given = F.when(content, F.col("hash"))
    before = F.last(given, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    now = F.last(given, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    reset = (content & (before.isNull() | (before != F.col("hash")))) | (ok & (F.col("hash") == now))
    marked = log.withColumn("_reset", F.when(reset, F.col("seq"))).withColumn("_last", F.max("_reset").over(at_key)).where("_last IS NOT NULL")
    failed = fail & (F.col("seq") > F.col("_last"))
    state = marked.groupBy(key).agg(
        F.max_by("hash", F.when(content, F.col("seq"))).alias("hash"), F.max_by("op", "_reset").alias("_op"), F.count_if(failed).cast("int").alias("attempts"),
        F.max_by("at", F.when(failed, F.col("seq"))).alias("_failed_at"), F.max_by(F.coalesce("error", F.lit("embedding failed")), F.when(failed, F.col("seq"))).alias("_error"),
    )
    status = F.when(F.col("attempts") >= MOST_ATTEMPTS, "failed").when((F.col("attempts") > 0) | (F.col("_op") == "content"), "pending").otherwise("done")
    wait = embedding_retry_seconds(F.col("attempts")).cast("int")
    retry = F.when((F.col("attempts") > 0) & (F.col("attempts") < MOST_ATTEMPTS), F.timestamp_add("SECOND", wait, F.col("_failed_at")))
    return state.select(key, "hash", status.alias("status"), "attempts", retry.alias("next_retry_at"), F.left("_error", F.lit(500)).alias("last_error"))


STATUSES = ["open", "triaged", "in_progress", "done", "declined"]


def valid_status(status: Column) -> Column:
    """The status in lower case, or an error for one that doesn't exist."""
    low = F.lower(F.trim(status))
    return F.when(low.isin(STATUSES), low).otherwise(F.raise_error(F.concat(F.lit("unknown report status: "), F.coalesce(status, F.lit("null")))))


def report_state(reports: DataFrame, updates: DataFrame) -> DataFrame:
    """Reports with their last status and notes; null notes leave the earlier ones, unknown ids are ignored."""
    checked = updates.select("id", "seq", valid_status(F.col("status")).alias("new_status"), F.trim("notes").alias("new_notes"))
    last = latest_given(checked, ["id"], "seq", ["new_status", "new_notes"])
    joined = reports.join(last, "id", "left")
    return joined.select("id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_notes", "admin_notes").alias("admin_notes"))


def job_states(log: DataFrame, job: str, status: str, at: str, as_of: Column, keep_hours: int) -> DataFrame:
    """The last status of each job; jobs that ended longer ago than ``keep_hours`` are gone."""
    last = log.groupBy(job).agg(F.max_by(status, at).alias("status"), F.max(at).alias("changed_at"))
    ended = F.col("status").isin("completed", "failed", "cancelled")
    return last.where(~ended | (F.col("changed_at") >= as_of - F.expr(f"INTERVAL {keep_hours} HOURS")))


# Kinds of reports.
REPORT_TYPES = ["issue", "feature"]


def new_reports(drafts: DataFrame, after: int = 0, types: list[str] = REPORT_TYPES) -> DataFrame:
    """Drafts (reporter_id, reporter_name, report_type, description, at) as open reports with ids from ``after`` + 1.

    Types are trimmed and in lower case, unknown ones are an error; descriptions are trimmed, drafts
    without one are left out (see faults_of_draft()); names keep 100 characters, times whole seconds.
    """
    kind = F.lower(F.trim(F.coalesce("report_type", F.lit(""))))
    known = F.when(kind.isin(types), kind).otherwise(F.raise_error(F.concat(F.lit("unknown report type: "), kind)))
    kept = drafts.withColumn("report_type", known).withColumn("description", F.regexp_replace("description", r"^\s+|\s+$", "")).where("description != ''")
    numbered = scans.numbered(kept, [], [F.col(c) for c in ("at", "reporter_id", "description", "report_type")], "id").withColumn("id", F.col("id") + after)
    second = F.date_trunc("SECOND", "at").cast(drafts.schema["at"].dataType)
    return numbered.select(
        "id", "reporter_id", F.left("reporter_name", F.lit(100)).alias("reporter_name"), "report_type", "description",
        F.lit("open").alias("status"), second.alias("created_at"), second.alias("updated_at"),
    )


def faults_of_draft(kind: Column, description: Column, types: list[str] = REPORT_TYPES) -> Column:
    """Why a draft is refused, as an array of texts."""
    rules = [(~F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin(types), "unknown type"), (F.trim(F.coalesce(description, F.lit(""))) == "", "no description")]
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))


def remaining(rows: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that no request of deletion names by its keys; what doesn't exist is no error."""
    return rows.join(requests.select(*keys).distinct(), keys, "left_anti")


def deletions(rows: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Each request with the number of rows that it deletes, and whether it deletes any."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = F.coalesce("_n", F.lit(0))
    return requests.join(counts, keys, "left").select(*requests.columns, found.alias("deleted_rows"), (found > 0).alias("deleted"))


def accepted_counts(batch: DataFrame, by: list[str], content: str, author_is_bot: Column, forced: Column) -> DataFrame:
    """Messages of a backfill and how many of them the index takes: people's (or forced ones') with a text."""
    taken = (~author_is_bot | forced) & (F.coalesce(normalised(F.col(content)), F.lit("")) != "")
    return batch.groupBy(*by).agg(F.count(F.lit(1)).alias("messages"), F.count_if(taken).alias("indexed"))


#: Messages of a channel that a backfill takes.
BACKFILL = 500


def backfill(history: DataFrame, own_bot: int | None = None, most: int = BACKFILL, by: str = "channel_id", at: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """The newest ``most`` messages of each channel as upserts for the index, and (channel, messages, indexed).

    ``history``: message_id, channel_id, author_id, is_bot, content and the index's other fields.
    Bots' messages are left out, but for those of ``own_bot``, and so is what has no text.  Each task
    keeps the newest of its own rows before they are brought together.  An upsert's ``seq`` is the
    message's time in microseconds.
    """
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc("message_id"))
    newest = history.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= max(0, most)).drop("_nth")
    bot = F.coalesce(F.col("is_bot"), F.lit(False))
    own = F.col("author_id") == F.lit(own_bot) if own_bot is not None else F.lit(False)
    taken = (~bot | F.coalesce(own, F.lit(False))) & (F.coalesce(normalised(F.col("content")), F.lit("")) != "")
    events = newest.where(taken).withColumns({"seq": F.unix_micros(F.col(at).cast("timestamp")), "op": F.lit("upsert")})
    counts = newest.groupBy(by).agg(F.count(F.lit(1)).alias("messages"), F.count_if(taken).alias("indexed"))
    return events, counts
