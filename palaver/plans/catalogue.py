"""Named queries over the test tables, each next to the SQL that gives the same rows.

The tables stand in for the message tables: documents and conversations for message texts, events
for the message stream and the usage log, embeddings for vectors, labels for visibility marks,
orders for reports.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.operators import changes, fulltext, markup, messages, retrieval, suggestions, usage, usage_log, vector_index, windows
from palaver.session import shared_folder
from palaver.sources import sinks
from palaver.sources.runs import Runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_fusion"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(rows: DataFrame, at: str):
    """The newest time of a table, as a subquery (one aggregate that reads one column)."""
    return rows.agg(F.max(at)).scalar()


# ---- usage -------------------------------------------------------------------------------------


@query("""SELECT user_id, round(sum(value), 2) AS total, count(*) AS requests FROM events WHERE event_type = 'purchase'
GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10""")
def token_leaderboard(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("total", F.col("value"))
    return usage.leaderboard(rows, ["user_id"], ["total"], "total", "user_id", 10)


ROLLUP = """SELECT count(*) AS messages, count_if(event_type = 'error') AS failures, count(DISTINCT user_id) AS users,
round(sum(value), 2) AS total_value, round(100.0 * (1 - count_if(event_type = 'error') / count(*)), 4) AS success_rate,
CAST(sum(50 + length(props) // 4) AS BIGINT) AS estimated_tokens FROM events"""


@query(ROLLUP)
def usage_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    n, bad = F.count(F.lit(1)), F.count_if(F.col("event_type") == "error")
    tokens = F.sum(usage.estimated_tokens(F.lit(1), F.length("props"))).cast("bigint")
    rate = F.round(100.0 * (1 - usage.ratio(bad, n, 0.0)), 4)
    return rows.agg(n.alias("messages"), bad.alias("failures"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total_value"), rate.alias("success_rate"), tokens.alias("estimated_tokens"))


@query(f"""WITH r AS ({ROLLUP}) SELECT metric, value FROM (
SELECT 'messages' AS metric, CAST(messages AS DOUBLE) AS value FROM r UNION ALL SELECT 'failures', CAST(failures AS DOUBLE) FROM r
UNION ALL SELECT 'total_value', CAST(total_value AS DOUBLE) FROM r UNION ALL SELECT 'success_rate', CAST(success_rate AS DOUBLE) FROM r)""")
def usage_report_long(spark, sf_dir):
    return sinks.long_format(usage_rollup(spark, sf_dir), ["messages", "failures", "total_value", "success_rate"])


@query("""SELECT event_type, count_if(sec < 86400) AS used, greatest(0, 100 - count_if(sec < 86400)) AS remaining,
min(CASE WHEN sec < 86400 THEN ts END) + INTERVAL 86400 SECONDS AS resets_at
FROM (SELECT *, epoch_us((SELECT max(ts) FROM events) - ts) / 1e6 AS sec FROM (SELECT event_type, ts FROM events)) GROUP BY event_type""")
def quota_remaining(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return usage.remaining_quota(rows, "event_type", "ts", as_of(rows, "ts"), 86_400, 100)


@query("""SELECT source, count(*) AS parts, CAST(sum(length) AS BIGINT) AS characters, round(avg(length), 4) AS mean_length, min(length) AS shortest,
max(length) AS longest, count_if(length = 500) AS full_parts FROM (SELECT source, length(substring(text, CAST(i * 500 + 1 AS BIGINT), 500)) AS length
FROM documents, LATERAL (SELECT unnest(range(0, greatest(CAST(ceil(length(text) / 500.0) AS BIGINT), 1))) AS i)) GROUP BY source""")
def split_statistics(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("source", F.explode(X.hard_split(F.col("text"), 500)).alias("part"))
    return usage.split_statistics(parts, ["source"], "part", 500)


@query("""SELECT doc_id, col, max(length(cell)) AS width FROM (SELECT doc_id, unnest(range(0, len(cells))) AS col, unnest(cells) AS cell FROM (
SELECT doc_id, string_split(line, ' | ') AS cells FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, ' | '))) GROUP BY doc_id, col""")
def column_widths(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains(" | "))
    return usage.column_widths(lines.select("doc_id", F.split("line", r" \| ").alias("cells")), ["doc_id"], "cells").select("doc_id", F.col("col").cast("bigint").alias("col"), "width")


# ---- scans and top-k ---------------------------------------------------------------------------


@query("""SELECT o_orderstatus, count(*) AS total, count_if(o_orderpriority LIKE '1%') AS urgent, count_if(o_totalprice > 100000) AS large FROM orders GROUP BY o_orderstatus""")
def status_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return usage.snapshot(rows, ["o_orderstatus"], urgent=F.col("o_orderpriority").startswith("1"), large=F.col("o_totalprice") > 100000)


@query("""SELECT lang, count(*) AS total, count_if(s = 'done') AS done, count_if(s = 'pending') AS pending, count_if(s = 'failed') AS failed
FROM (SELECT lang, CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'failed' END AS s FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang""")
def embedding_status_counts(spark, sf_dir):
    status = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").alias("embedding_status"))
    return messages.status_counts(table(spark, sf_dir, "documents"), status, "doc_id", ["lang"])


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 40")
def recent_scoped(spark, sf_dir):
    rows = messages.in_scope(table(spark, sf_dir, "events"), channel="click", channel_col="event_type")
    return messages.recent(rows, "ts", "event_id", 40).select("event_id", "ts", "user_id", "value")


@query("""SELECT event_id, ts, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)
ORDER BY ts DESC, event_id DESC LIMIT 40""")
def recent_excluding(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    kept = messages.excluding(rows, rows.where("event_type = 'error' AND value > 90").select("user_id").distinct(), "user_id")
    return messages.recent(kept, "ts", "event_id", 40).select("event_id", "ts", "user_id")


@query("SELECT doc_id, source, length(text) AS characters FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def visible_messages(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").where("toxic = 1")
    return messages.visible_by_marks(table(spark, sf_dir, "documents"), marks, "doc_id").select("doc_id", "source", F.length("text").alias("characters"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def cutoff_24h(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return messages.since(rows, "ts", as_of(rows, "ts"), 24).select("event_id", "ts", "event_type")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def messages_by_ids(spark, sf_dir):
    return messages.by_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id").select("doc_id", "source", "lang")


@query("""SELECT doc_id, concat('title: Discord message by ', source, ' at ', strftime(sent, '%Y-%m-%dT%H:%M:%S'), ' | text: ', text) AS document, sha256(text) AS content_hash
FROM (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(CAST(n_chars AS BIGINT)) AS sent FROM documents) JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 ORDER BY n_chars DESC, doc_id DESC LIMIT 16""")
def pending_embeddings(spark, sf_dir):
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = docs.join(marks, "doc_id").select(F.col("doc_id").alias("message_id"), F.col("source").alias("author_name"), F.col("text").alias("content_text"), F.timestamp_add("SECOND", F.col("n_chars"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"), (F.col("toxic") == 1).alias("hidden"), F.lit(None).alias("deleted_at"))
    vectors = docs.join(marks, "doc_id").select(F.col("doc_id").alias("message_id"), F.sha2("text", 256).alias("content_hash"), F.lit("m").alias("embedding_model"), F.when(F.col("quality") == 1, "pending").otherwise("done").alias("embedding_status"), F.lit(None).cast("timestamp").alias("next_retry_at"))
    return messages.pending_embeddings(index, vectors, "m", F.current_timestamp(), 16).withColumnRenamed("message_id", "doc_id")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 200")
def reports_recent(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderkey")).limit(messages.bounded(200)).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'signup' ORDER BY ts, event_id")
def pins_oldest_first(spark, sf_dir):
    return messages.chronological(table(spark, sf_dir, "events").where("event_type = 'signup'"), "ts", "event_id").select("event_id", "ts", "value")


@query("""SELECT conv_id, turn, length(text) AS characters FROM (SELECT *, row_number() OVER (ORDER BY turn DESC, conv_id DESC) AS n FROM conversations WHERE role = 'assistant')
WHERE n <= 100 AND text <> '' AND text <> '.' ORDER BY turn DESC, conv_id DESC LIMIT 10""")
def hideable_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return messages.hideable(rows, "turn", "conv_id", "text", 100).select("conv_id", "turn", F.length("text").alias("characters"))


@query("SELECT DISTINCT p_type AS value FROM part WHERE contains(lower(p_type), 'e') ORDER BY value LIMIT 25")
def autocomplete(spark, sf_dir):
    return messages.complete(table(spark, sf_dir, "part"), "p_type", "E").select("value")


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id""")
def latest_per_author(spark, sf_dir):
    return windows.newest_of(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "ts")


# ---- windows -----------------------------------------------------------------------------------

CONV = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)"


@query(f"""SELECT a.conv_id, a.turn AS anchor, b.turn, b.rn - a.rn AS "offset" FROM {CONV} a JOIN {CONV} b ON a.conv_id = b.conv_id AND abs(b.rn - a.rn) <= 2
WHERE a.role = 'user' AND (b.role <> 'system' OR a.rn = b.rn)""")
def neighbourhood_anchor(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    near = windows.neighbours(rows, rows.where("role = 'user'"), "conv_id", "turn", [F.col("turn")], 2, 2, F.col("role") == "system")
    return near.select("conv_id", "anchor", "turn", F.col("offset").cast("bigint").alias("offset"))


GAPS = "(SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)"


@query(f"""SELECT user_id, session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400000000 THEN 1 ELSE 0 END)
OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM {GAPS}) GROUP BY user_id, session""")
def sessions_24h(spark, sf_dir):
    rows = windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 86_400, "event_id")
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT user_id, event_id, ts FROM (SELECT *, sum(CASE WHEN gap > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS gaps,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM (SELECT *, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) - epoch_us(ts) AS gap FROM events))
WHERE gaps = 0 AND back <= 500""")
def session_tail_24h(spark, sf_dir):
    return windows.session_tail(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts")


@query("""SELECT conv_id, turn, len(b) AS buffered, list_aggregate(b, 'min') AS oldest FROM (SELECT conv_id, turn,
list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS b FROM conversations)""")
def rolling_last12(spark, sf_dir):
    rows = windows.rolling_buffer(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], "turn")
    return rows.select("conv_id", "turn", F.size("buffer").alias("buffered"), F.array_min("buffer").alias("oldest"))


@query("""SELECT conv_id, turn, role, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS kept FROM conversations""")
def prefix_to_first_flag(spark, sf_dir):
    return windows.through_first(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], F.col("role") == "assistant").select("conv_id", "turn", "role", "kept")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_count_1h(spark, sf_dir):
    return windows.sliding_count(table(spark, sf_dir, "events"), ["user_id"], "ts", 3600).select("event_id", "in_window")


@query("""SELECT event_id, concat('CTX_MSG_', CASE WHEN n < 10 THEN '00' WHEN n < 100 THEN '0' ELSE '' END, n) AS label FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)""")
def ordinal_labels(spark, sf_dir):
    return windows.ordinal_labels(table(spark, sf_dir, "events"), ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "label")


@query("""SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def last_five(spark, sf_dir):
    return windows.last_rows(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", F.col("rn").cast("bigint").alias("rn"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS requests, CAST(sum(cents) AS BIGINT) AS total_tokens FROM (SELECT user_id, event_id, CAST(floor(value * 100) AS BIGINT) AS cents FROM events WHERE value >= 0)
WHERE event_id % 5 <> 0 GROUP BY user_id ORDER BY total_tokens DESC, user_id LIMIT 10""")
def leaders_by_increments(spark, sf_dir):
    """Usage in three batches, a fifth of it taken back in later ones."""
    cents = F.floor(F.col("value") * 100).cast("bigint")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", F.lit(None).cast("string").alias("username"), F.lit(0).alias("input_tokens"), cents.alias("output_tokens"), cents.alias("total_tokens"))
    path, added, back = shared_folder(spark, "usage"), rows.withColumn("op", F.lit("add")), rows.where("seq % 5 = 0").withColumn("op", F.lit("retract"))
    for i in range(3):
        batch = added.where(f"seq % 3 = {i}")
        usage_log.apply_usage(batch.unionByName(back.where("seq % 3 = 0" if i == 1 else "seq % 3 > 0")) if i else batch, path, i)
    return usage_log.leaders(spark, path, 10).select("user_id", "requests", "total_tokens")


# ---- retrieval ---------------------------------------------------------------------------------

SEARCH = "thing the-eron token"
BM25_SQL = """SELECT doc_id, round(s0 + s1 + s2, 6) AS score FROM (SELECT doc_id, tf0 + tf1 + tf2 AS hits, {parts} FROM c, s) WHERE hits > 0"""
_PART = "greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0.000001) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean)) AS s{i}"
SCORED = (
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t FROM documents),
c AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS length, CAST(len(list_filter(t, lambda x: x = 'thing')) AS DOUBLE) AS tf0,
CAST(len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'eron')) AS DOUBLE) AS tf1, CAST(len(list_filter(t, lambda x: x = 'token')) AS DOUBLE) AS tf2 FROM w),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean, CAST(count_if(tf0 > 0) AS DOUBLE) AS df0, CAST(count_if(tf1 > 0) AS DOUBLE) AS df1, CAST(count_if(tf2 > 0) AS DOUBLE) AS df2 FROM c) """
    + BM25_SQL.format(parts=", ".join(_PART.format(i=i) for i in range(3)))
)
BM25_SQL = f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM ({SCORED}) ORDER BY score DESC, doc_id LIMIT 40)"


def text_index(spark, sf_dir):
    """The documents' full-text index, built by the first query that needs it and again once the table's files change."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select("path", "modificationTime", "length").collect()
    path = shared_folder(spark, f"fulltext{fulltext.FORMAT}", hashlib.sha256(repr(sorted(map(tuple, files))).encode()).hexdigest()[:32])
    fulltext.apply_changes(as_upserts(table(spark, sf_dir, "documents")), path, 0, "doc_id")
    return path


def as_upserts(docs):
    return docs.select(F.lit(0).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), "doc_id", F.col("text").alias("content"))


def lexical(spark, sf_dir, most=40):
    return fulltext.search(spark, text_index(spark, sf_dir), SEARCH, most).withColumnRenamed("key", "doc_id")


@query("""SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT b.doc_id, score FROM ({SCORED}) b JOIN documents USING (doc_id) WHERE source = 'src3' ORDER BY score DESC, b.doc_id LIMIT 15)""".replace("{SCORED}", SCORED))
def bm25_scoped(spark, sf_dir):
    """The scope holds before the best are taken."""
    scope = table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id")
    return fulltext.search(spark, text_index(spark, sf_dir), SEARCH, 15, scope).select(F.col("key").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(BM25_SQL)
def bm25_unindexed(spark, sf_dir):
    found = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", SEARCH, 40)
    return found.select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(BM25_SQL)
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir).select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


CHANGED = """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 13 = 2 THEN concat('token thing edited ', source) ELSE text END AS content, source AS author, lang AS files FROM documents
  WHERE doc_id % 11 <> 5 AND (doc_id % 7 <> 3 OR doc_id % 2 = 0) AND regexp_matches(text, '[^\\s]')),
w AS (SELECT doc_id, list_transform([content, author, files], lambda f: regexp_extract_all(lower(strip_accents(coalesce(f, ''))), '[\\p{L}\\p{N}]+')) AS fields FROM m),
c AS (SELECT doc_id, CAST(list_sum(list_transform(fields, lambda f: len(f))) AS DOUBLE) AS length, CAST(list_sum(list_transform(fields, lambda t: len(list_filter(t, lambda x: x = 'thing')))) AS DOUBLE) AS tf0,
  CAST(list_sum(list_transform(fields, lambda t: len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' AND t[i + 1] = 'eron')))) AS DOUBLE) AS tf1, CAST(list_sum(list_transform(fields, lambda t: len(list_filter(t, lambda x: x = 'src3')))) AS DOUBLE) AS tf2 FROM w),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean, CAST(count_if(tf0 > 0) AS DOUBLE) AS df0, CAST(count_if(tf1 > 0) AS DOUBLE) AS df1, CAST(count_if(tf2 > 0) AS DOUBLE) AS df2 FROM c) """


def changed_index(spark, sf_dir):
    """A new index of the documents after edits, hidings and deletions, some of them undone, in four batches and a merge of two."""
    docs, path = table(spark, sf_dir, "documents"), shared_folder(spark, "fulltext")
    event = lambda seq, op, rows, text=None: rows.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), "doc_id", (F.col("text") if text is None else text).alias("content"), F.col("source").alias("author_name"), F.col("lang").alias("attachment_summary"))
    hidden = docs.where("doc_id % 7 = 3")
    edited = event(4, "upsert", docs.where("doc_id % 13 = 2 AND text RLIKE '[^\\\\s]'"), F.concat(F.lit("token thing edited "), "source"))
    for i, batch in enumerate([event(1, "upsert", docs), event(2, "hide", hidden).unionByName(event(3, "delete", docs.where("doc_id % 11 = 5"))), edited, event(5, "unhide", hidden.where("doc_id % 2 = 0"))]):
        fulltext.apply_changes(batch, path, i, "doc_id")
        if i == 2:
            fulltext.merge(spark, path, Runs(spark, path).live()[1:])
    return path


@query(CHANGED + """SELECT CAST(n AS BIGINT) AS texts, CAST(sum(length) AS BIGINT) AS terms FROM c, s GROUP BY n""")
def fulltext_build(spark, sf_dir):
    """Its time is that of building the index, unlike those of the searches."""
    return fulltext.index_size(spark, changed_index(spark, sf_dir)).select("texts", "terms")


@query("SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(s0 + s1 + s2, 6) AS score FROM (" + CHANGED + "SELECT doc_id, tf0 + tf1 + tf2 AS hits, " + ", ".join(_PART.format(i=i) for i in range(3)) + " FROM c, s) WHERE hits > 0 ORDER BY score DESC, doc_id LIMIT 40)")
def fulltext_after_changes(spark, sf_dir):
    found = fulltext.search(spark, changed_index(spark, sf_dir), "thing the-eron src3", 40)
    return found.select(F.col("key").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


COSINE_SQL = """SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings) WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 40"""


def semantic(spark, sf_dir, most=40):
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(rows, "vec_id", "embedding", rows.where("vec_id = 0").first()["embedding"], most)


@query(COSINE_SQL)
def cosine_topk(spark, sf_dir):
    return semantic(spark, sf_dir).select("vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(COSINE_SQL.replace("FROM embeddings) WHERE", "FROM embeddings WHERE label % 2 = 1) WHERE"))
def cosine_indexed(spark, sf_dir):
    """By the folders of an index that is built here, among the vectors of some labels."""
    rows, path = table(spark, sf_dir, "embeddings"), shared_folder(spark, "vectors")
    vector_index.build(rows, path, "vec_id", "embedding")
    found = vector_index.search(spark, path, rows.where("vec_id = 0").first()["embedding"], 40, rows.where("label % 2 = 1").select("vec_id"))
    return found.select(F.col("key").alias("vec_id"), "score", F.col("rank").cast("bigint").alias("rank"))


# a message's time: hours after the epoch by its id
AT_SQL = "TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 720 AS BIGINT))"
FUSION_SQL = f"""WITH docs AS (SELECT doc_id, {AT_SQL} AS sent FROM documents), latest AS (SELECT max(sent) AS now FROM docs), lex AS ({BM25_SQL}), sem AS ({COSINE_SQL}),
rec AS (SELECT doc_id, row_number() OVER (ORDER BY sent DESC, doc_id DESC) AS rank FROM docs ORDER BY sent DESC, doc_id DESC LIMIT 20),
u AS (SELECT doc_id, 0 AS ord, 'recent' AS source, rank, 0.7 AS w FROM rec UNION ALL SELECT doc_id, 1, 'lexical', rank, 2.0 FROM lex
UNION ALL SELECT vec_id, 2, 'semantic', rank, 2.0 FROM sem WHERE vec_id IN (SELECT doc_id FROM docs)),
p AS (SELECT u.*, w / rank + 0.2 * pow(0.5, greatest((epoch(now) - epoch(sent)) / 3600.0, 0) / 72.0) AS part FROM u JOIN docs USING (doc_id), latest),
f AS (SELECT doc_id, round(sum(part), 6) AS score, string_agg(source, '+' ORDER BY source) AS sources, min(ord * 1000000 + rank) AS first FROM p GROUP BY doc_id)
SELECT doc_id, score, sources, row_number() OVER (ORDER BY score DESC, first, doc_id) AS rank FROM f ORDER BY score DESC, first, doc_id LIMIT 30"""


def fused(spark, sf_dir):
    at = F.timestamp_add("HOUR", F.pmod("doc_id", F.lit(720)), F.lit("2024-01-01").cast("timestamp"))
    docs = table(spark, sf_dir, "documents").select("doc_id", at.alias("at"))
    most = retrieval.budgets(retrieval.tier_limit("high"))
    recent = retrieval.ranked(docs, [F.desc("at"), F.desc("doc_id")], most["recent"])
    lists = {
        "recent": recent,
        "lexical": lexical(spark, sf_dir).join(docs, "doc_id"),
        "semantic": semantic(spark, sf_dir, most["semantic"]).withColumnRenamed("vec_id", "doc_id").join(docs, "doc_id"),
    }
    return retrieval.fuse(lists, "doc_id", "at", as_of(docs, "at"), most["pool"])


@query(FUSION_SQL)
def hybrid_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("doc_id", "score", "sources", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH fused AS ({FUSION_SQL}), b AS (SELECT doc_id, 0 AS bucket, doc_id AS pos FROM (SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 12)
UNION ALL SELECT doc_id, 1, rank FROM fused), o AS (SELECT doc_id, min(bucket) AS bucket, min_by(pos, bucket) AS pos FROM b GROUP BY doc_id)
SELECT doc_id, CASE bucket WHEN 0 THEN 'pin' ELSE 'retrieved' END AS part, row_number() OVER (ORDER BY bucket, pos, doc_id) AS slot FROM o ORDER BY bucket, pos, doc_id LIMIT 12""")
def context_pack(spark, sf_dir):
    pins = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.col("doc_id").alias("pos"))
    found = fused(spark, sf_dir).select("doc_id", F.col("rank").cast("bigint").alias("pos"))
    return retrieval.pack(pins, found, "doc_id", "pos", retrieval.tier_limit("high")).select("doc_id", "part", F.col("slot").cast("bigint").alias("slot"))


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256)).select("doc_id", "source", "lang", "h")
    return retrieval.keep_first(rows, ["h"], [F.col("doc_id")]).select("doc_id", "source", "lang")


# ---- texts -------------------------------------------------------------------------------------

NORMAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, length({NORMAL}) AS characters, sha256({NORMAL}) AS content_hash FROM documents")
def normalize_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.normalised(F.col("text"))).alias("characters"), X.content_hash(F.col("text")).alias("content_hash"))


@query(r"""SELECT item_id, array_to_string(list_filter(t, lambda x, i: NOT list_contains(list_transform(t[1:i - 1], lambda y: lower(y)), lower(x))), ' ') AS tokens
FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9_@#./:\-]+') AS t FROM benchmark)""")
def query_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.query_tokens(F.col("text"), most=None, least=1), " ").alias("tokens"))


@query(r"""SELECT doc_id, regexp_matches(t, '(https?://|www\.)|\bsearch\b|\bweb search\b|\binternet search\b|\blook ?up\b|\bcheck online\b|\bfind online\b|\bgoogle\b|\bsearch for\b')
OR regexp_matches(t, '\b(news|weather|forecast|stock price|crypto price|scores?|standings)\b')
OR (regexp_matches(t, '\b(latest|newest|most recent|breaking|today(?:''s)?|recent)\b') AND regexp_matches(t, '\b(news|updates?|events?|prices?|scores?)\b')) AS wants_search
FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)""")
def search_intent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.wants_search(F.col("text")).alias("wants_search"))


ERROR_CASE = """CASE WHEN t LIKE '%image size%' OR t LIKE '%file too large%' OR t LIKE '%exceeds maximum size%' THEN 'image_size_error'
WHEN t LIKE '%unsupported format%' OR t LIKE '%invalid format%' OR t LIKE '%image format%' THEN 'image_format_error'
WHEN t LIKE '%nano-banana%' OR contains(t, 'nano_banana') OR t LIKE '%image editing service%' THEN 'nano_banana_api_error'
WHEN t LIKE '%image validation%' OR t LIKE '%corrupted image%' OR t LIKE '%invalid image%' THEN 'image_validation_error'
WHEN t LIKE '%image upload%' OR t LIKE '%upload failed%' THEN 'image_upload_error' WHEN t LIKE '%image download%' OR t LIKE '%download failed%' THEN 'image_download_error'
WHEN t LIKE '%image processing%' OR t LIKE '%image edit%' THEN 'image_processing_error' WHEN t LIKE '%message split%' OR t LIKE '%splitting failed%' THEN 'message_split_error'
WHEN t LIKE '%markdown processing%' OR t LIKE '%markdown error%' THEN 'markdown_processing_error' WHEN t LIKE '%message too long%' OR t LIKE '%exceeds character limit%' THEN 'message_too_long_error'
WHEN t LIKE '%rate limit%' OR t LIKE '%quota exceeded%' OR t LIKE '%too many requests%' THEN 'rate_limit' WHEN t LIKE '%timeout%' OR t LIKE '%timed out%' THEN 'timeout'
WHEN t LIKE '%authentication%' OR t LIKE '%unauthorized%' OR t LIKE '%api key%' OR t LIKE '%invalid key%' THEN 'authentication_error'
WHEN t LIKE '%service unavailable%' OR t LIKE '%server error%' OR t LIKE '%503%' OR t LIKE '%502%' OR t LIKE '%500%' THEN 'service_unavailable'
WHEN t LIKE '%empty response%' OR t LIKE '%no content%' OR t LIKE '%blank response%' THEN 'empty_response'
WHEN t LIKE '%invalid request%' OR t LIKE '%bad request%' OR t LIKE '%400%' OR t LIKE '%malformed%' THEN 'invalid_request'
WHEN t LIKE '%config%' OR t LIKE '%missing token%' OR t LIKE '%token not found%' THEN 'configuration_error' WHEN t LIKE '%validation%' OR t LIKE '%format error%' THEN 'validation_error'
WHEN t LIKE '%context%' OR t LIKE '%history%' OR t LIKE '%message retrieval%' THEN 'context_collection_error' ELSE 'unknown_error' END"""


@query(f"""SELECT category, count(*) AS documents, bool_or(category IN ('rate_limit', 'timeout', 'service_unavailable', 'discord_http_error', 'discord_connection_error', 'nano_banana_api_error', 'image_upload_error', 'image_download_error', 'message_split_error')) AS retryable,
max(CASE WHEN category IN ('rate_limit', 'timeout', 'empty_response') THEN 'WARNING' ELSE 'ERROR' END) AS level FROM (SELECT {ERROR_CASE} AS category FROM (SELECT lower(text) AS t FROM documents)) GROUP BY category""")
def error_category(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(X.error_category(F.col("text")).alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("documents"), F.bool_or(X.is_retryable(F.col("category"))).alias("retryable"), F.max(X.log_level(F.col("category"))).alias("level"))


EDIT_SQL = r"""WITH t AS (SELECT conv_id, turn, trim(lower(text)) AS t FROM conversations), k AS (SELECT conv_id, turn,
len(regexp_extract_all(t, '\b(remove|delete|erase|eliminate|take\s+out)\b.*\b(object|person|thing|item)\b')) + len(regexp_extract_all(t, '\b(get\s+rid\s+of|clear\s+away)\b')) + len(regexp_extract_all(t, '\bremove\s+the\s+\w+')) + len(regexp_extract_all(t, '\bdelete\s+\w+')) AS removal,
len(regexp_extract_all(t, '\b(change|replace|swap|switch)\s+(the\s+)?background\b')) + len(regexp_extract_all(t, '\bbackground\s+(to|with|as)\b')) + len(regexp_extract_all(t, '\bput\s+.*\s+(in|on|at|to)\b')) + len(regexp_extract_all(t, '\bplace\s+.*\s+(in|on|at|to)\b'))
  + len(regexp_extract_all(t, '\bmake\s+the\s+background\b')) + len(regexp_extract_all(t, '\bon\s+top\s+of\b')) + len(regexp_extract_all(t, '\bin\s+front\s+of\b')) + len(regexp_extract_all(t, '\b(move|relocate|position)\s+\w+\s+to\b')) AS background,
len(regexp_extract_all(t, '\b(style|artistic|art)\s+(of|like|as)\b')) + len(regexp_extract_all(t, '\bmake\s+it\s+(look\s+like|in\s+the\s+style\s+of)\b')) + len(regexp_extract_all(t, '\b(convert|transform)\s+to\s+\w+\s+style\b')) + len(regexp_extract_all(t, '\bapply\s+.*\s+style\b')) AS style,
len(regexp_extract_all(t, '\b(adjust|change|modify)\s+(color|brightness|contrast|saturation)\b')) + len(regexp_extract_all(t, '\bmake\s+it\s+(brighter|darker|more\s+colorful|less\s+colorful)\b')) + len(regexp_extract_all(t, '\b(increase|decrease|enhance)\s+(brightness|contrast|saturation)\b')) + len(regexp_extract_all(t, '\bcolor\s+(correction|grading)\b')) AS color FROM t)
SELECT conv_id, turn, CASE WHEN m = 0 THEN 'general_edit' WHEN removal = m THEN 'object_removal' WHEN background = m THEN 'background_replacement' WHEN style = m THEN 'style_transfer' ELSE 'color_adjustment' END AS kind,
CAST(CASE WHEN m = 0 THEN 0.5 ELSE least(m / 3.0, 1.0) END AS DOUBLE) AS confidence FROM (SELECT *, greatest(removal, background, style, color) AS m FROM k)"""


@query(EDIT_SQL.replace("trim(lower(text))", "trim(lower(concat(CASE turn % 5 WHEN 1 THEN 'remove the hat, ' WHEN 2 THEN 'change background to blue and ' WHEN 3 THEN 'make it brighter with more color correction ' WHEN 4 THEN 'delete it; apply oil style ' ELSE '' END, text)))"))
def edit_kind(spark, sf_dir):
    turn = F.col("turn") % 5
    asked = F.when(turn == 1, "remove the hat, ").when(turn == 2, "change background to blue and ").when(turn == 3, "make it brighter with more color correction ").when(turn == 4, "delete it; apply oil style ").otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.edit_kind(F.concat(asked, F.coalesce("text", F.lit("")))).alias("e"))
    return rows.select("conv_id", "turn", "e.kind", F.col("e.confidence").cast("double").alias("confidence"))


@query("""SELECT conv_id, string_agg(concat('[', lpad(CAST(turn // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(turn % 60 AS VARCHAR), 2, '0'), '] ', role, CASE WHEN turn > 0 THEN ' (replying)' ELSE '' END, ': ',
CASE WHEN length(text) > 80 THEN concat(left(text, 80), '...') ELSE text END), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id""")
def truncate_format_lines(spark, sf_dir):
    at = F.timestamp_add("MINUTE", F.col("turn"), F.lit("2024-01-01").cast("timestamp"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.chat_line(at, F.col("role"), X.truncated(F.col("text"), 80), F.col("turn") > 0).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


@query("""SELECT doc_id, i AS part, substring(text, CAST(i * 500 + 1 AS BIGINT), 500) AS piece FROM documents, LATERAL (SELECT unnest(range(0, greatest(CAST(ceil(length(text) / 500.0) AS BIGINT), 1))) AS i)""")
def hard_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.hard_split(F.col("text"), 500)).alias("part", "piece"))
    return rows.select("doc_id", F.col("part").cast("bigint").alias("part"), "piece")


@query("""SELECT event_id, k, CAST(k + 0 AS BIGINT) AS total FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL AND k >= 0""")
def json_extract_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", X.token_usage(F.col("props"), inputs=["absent", "k"]).alias("u")).where("u IS NOT NULL")
    return rows.select("event_id", F.col("u.input_tokens").alias("k"), F.col("u.total_tokens").alias("total"))


@query("""SELECT event_id, concat_ws(' ', CASE WHEN s >= 86400 THEN concat(s // 86400, 'd') END, CASE WHEN s % 86400 >= 3600 THEN concat(s % 86400 // 3600, 'h') END,
CASE WHEN s % 3600 >= 60 THEN concat(s % 3600 // 60, 'm') END, CASE WHEN s % 60 > 0 OR s = 0 THEN concat(s % 60, 's') END) AS duration
FROM (SELECT event_id, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS s FROM events)""")
def humanize_duration(spark, sf_dir):
    seconds = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1e6)
    return table(spark, sf_dir, "events").select("event_id", X.duration_text(seconds).alias("duration"))


@query(r"""SELECT p_partkey, replace(trim(left(regexp_replace(p_name, '[^\p{L}\p{N} _\-]', '', 'g'), 30)), ' ', '_') AS filename FROM part""")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_filename(F.col("p_name")).alias("filename"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(text, '<@!?\d+>|@everyone|@here', '', 'g')), '\s+', ' ', 'g')) AS prompt FROM conversations""")
def prompt_extraction(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.without_mentions(F.col("text")).alias("prompt"))


@query("""SELECT p_partkey, round(least(greatest(mp * CASE p_size % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 1.5 ELSE 3.0 END * CASE WHEN mp > 10 THEN 1.5 WHEN mp > 5 THEN 1.2 ELSE 1.0 END, 5.0), 120.0), 1)::DOUBLE AS seconds
FROM (SELECT p_partkey, p_size, (p_size * 100) * (p_size * 80) / 1000000 AS mp FROM part)""")
def processing_time(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("style_transfer"), F.lit("color_adjustment"), F.lit("other")), F.col("p_size") % 3 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", X.edit_seconds(kind, F.col("p_size") * 100, F.col("p_size") * 80).cast("double").alias("seconds"))


@query("""SELECT l_orderkey, l_linenumber, least(pow(2.0, l_linenumber) + l_discount, 30.0) AS delay, least(60 * pow(2.0, l_linenumber - 1), 3600.0) AS retry FROM lineitem""")
def backoff_delays(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.backoff_seconds(F.col("l_linenumber"), F.col("l_discount")).alias("delay"), X.embedding_retry_seconds(F.col("l_linenumber")).alias("retry"))


# ---- changes -----------------------------------------------------------------------------------


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS updated_seq FROM events GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return changes.latest(rows.withColumn("updated_seq", F.col("event_id")), ["user_id"], "event_id", ["event_type", "value", "updated_seq"])


@query("""SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN value END, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def keyed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("click", "view")])
    return changes.latest_given(rows, ["user_id"], "event_id", ["click", "view"])


@query("""WITH l AS (SELECT user_id, event_id, event_type FROM events), b AS (SELECT user_id, min(event_id) FILTER (event_type IN ('view', 'purchase')) AS born FROM l GROUP BY user_id),
s AS (SELECT l.user_id, max(event_id) FILTER (event_type IN ('view', 'purchase')) AS updated_seq, max(event_id) FILTER (event_type = 'error' AND event_id > born) AS del,
max(event_id) FILTER (event_type IN ('click', 'signup') AND event_id > born) AS hs, arg_max(event_type, event_id) FILTER (event_type IN ('click', 'signup') AND event_id > born) AS h
FROM l JOIN b USING (user_id) WHERE born IS NOT NULL GROUP BY l.user_id)
SELECT user_id, updated_seq, CASE WHEN hs IS NOT NULL AND (del IS NULL OR hs > del) THEN h = 'click' ELSE del IS NOT NULL END AS hidden, del IS NOT NULL AS deleted FROM s""")
def tombstone_fold(spark, sf_dir):
    op = F.create_map(*[F.lit(x) for p in {"click": "hide", "signup": "unhide", "error": "delete", "view": "upsert", "purchase": "upsert"}.items() for x in p])[F.col("event_type")]
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), "user_id", F.col("props").alias("content"))
    return changes.message_state(log, "user_id").select("user_id", "updated_seq", "hidden", "deleted")


@query("""SELECT o_orderkey AS id, coalesce(u.s, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'triaged' END) AS status, u.n AS admin_notes FROM orders
LEFT JOIN (SELECT l_orderkey, arg_max(CASE l_returnflag WHEN 'R' THEN 'declined' WHEN 'A' THEN 'in_progress' ELSE 'done' END, q) AS s,
arg_max(l_linestatus, q) FILTER (l_returnflag = 'R') AS n FROM (SELECT *, CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey) u ON l_orderkey = o_orderkey""")
def report_status(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("triaged")
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit(None).cast("string").alias("admin_notes"))
    new = F.when(F.col("l_returnflag") == "R", " Declined").when(F.col("l_returnflag") == "A", "IN_PROGRESS").otherwise("done")
    updates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("seq"), new.alias("status"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("notes"))
    return changes.report_state(reports, updates)


@query("""SELECT user_id, status, changed_at FROM (SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END, ts) AS status, max(ts) AS changed_at FROM events GROUP BY user_id)
WHERE status = 'processing' OR changed_at >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS""")
def job_states(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return changes.job_states(rows.withColumn("status", status), "user_id", "status", "ts", as_of(rows, "ts"), 24)


# ---- sequential texts --------------------------------------------------------------------------


@query()
def safe_split(spark, sf_dir):
    return markup.split_messages(table(spark, sf_dir, "documents"), "doc_id", "text", 500)


@query()
def markdown_blocks(spark, sf_dir):
    return markup.markdown_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def fuzzy_suggest(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.lower("p_name").alias("typed")).distinct()
    known = table(spark, sf_dir, "part").select(F.lower("p_type").alias("command")).distinct()
    return suggestions.suggest(words, known)
