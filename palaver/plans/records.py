"""More named queries with their SQL: prompts, limits, records and their validation, markup.

Names and lists in the SQL are written out by hand, so that a wrong list in the library shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import rules
from palaver.functions import text as X
from palaver.operators import changes, limits, markup, messages, retrieval, suggestions, usage, windows
from palaver.plans.catalogue import as_of, query, table

# ---- prompts -----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, concat('CTX_MSG_', lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user')),
m AS (SELECT conv_id, max(turn) AS current FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, turn + 1 AS image_index, coalesce(label, CASE WHEN turn = current THEN 'CURRENT_USER_MESSAGE' WHEN turn = 1 THEN 'REPLIED_TO_MESSAGE' ELSE 'NON_CONTEXT_MESSAGE' END) AS source_message_order
FROM conversations JOIN m USING (conv_id) LEFT JOIN c USING (conv_id, turn)""")
def image_source_order(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    newest = rows.groupBy("conv_id").agg(F.max("turn").alias("current"))
    images = rules.image_order(rows.join(newest, "conv_id").withColumns({"replied": F.lit(1), "page": F.lit(None).cast("int"), "nth": F.lit(0)}), ["conv_id"], "turn", "turn", "nth", "page")
    placed = windows.image_orders(images, rows.where("role = 'user'"), "conv_id", "turn", [F.col("turn")], "current", "replied")
    return placed.select("conv_id", "turn", F.col("image_index").cast("bigint").alias("image_index"), "source_message_order")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY b, CASE WHEN b = 0 THEN doc_id END, CASE WHEN b = 2 THEN score END, CASE WHEN b > 0 THEN n_chars END, doc_id) AS slot
FROM (SELECT doc_id, source, n_chars, coalesce(quality, 0) / 2.0 AS score, CASE WHEN toxic = 1 THEN 0 WHEN doc_id % 7 = 0 THEN 1 ELSE 2 END AS b FROM documents LEFT JOIN labels USING (doc_id))""")
def prompt_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    pinned, anchor = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("doc_id") % 7 == 0
    ordered = retrieval.prompt_order(rows, ["source"], pinned, anchor, F.col("doc_id"), F.col("quality") / 2.0, F.col("n_chars"), F.col("doc_id"))
    return ordered.select("doc_id", F.col("slot").cast("bigint").alias("slot"))


@query("""SELECT * FROM (VALUES ('low', 4, 20, 40, 40, 30, 10), ('medium', 8, 20, 40, 40, 30, 30), ('high', 12, 20, 40, 40, 30, 50), ('other', 4, 20, 40, 40, 30, 10), ('wide', 60, 60, 40, 40, 60, 60))
AS t(tier, most, recent, lexical, semantic, pool, plain)""")
def candidate_budgets(spark, sf_dir):
    tiers = [(t, retrieval.tier_limit(t), retrieval.tier_limit(t, retrieval.PLAIN_TIERS)) for t in ("low", "medium", "high", "other")] + [("wide", 60, 60)]
    rows = [(t, most, *(retrieval.budgets(most)[k] for k in ("recent", "lexical", "semantic", "pool")), plain) for t, most, plain in tiers]
    return spark.createDataFrame(rows, "tier string, most int, recent int, lexical int, semantic int, pool int, plain int")


@query("""WITH b AS (SELECT doc_id, 0 AS bucket, doc_id % 50 AS pos FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1, doc_id FROM labels WHERE toxic = 1),
o AS (SELECT doc_id, min((bucket, pos)) AS f FROM b GROUP BY doc_id),
k AS (SELECT doc_id, n_chars FROM documents JOIN o USING (doc_id) ORDER BY f DESC, doc_id DESC LIMIT 25)
SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM k""")
def selection_with_anchors(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    chosen = labels.where("quality = 1").select("doc_id", (F.col("doc_id") % 50).alias("position"))
    anchors = labels.where("toxic = 1").select("doc_id", F.col("doc_id").alias("position"))
    picked = retrieval.select_and_anchor(table(spark, sf_dir, "documents"), chosen, anchors, "doc_id", "n_chars", 25)
    return retrieval.ranked(picked, [F.asc("n_chars"), F.asc("doc_id")], 25).select("doc_id", F.col("rank").cast("bigint").alias("place"))


@query("""SELECT conv_id, concat('=== PINNED MEMORIES FOR THIS CHANNEL ===', chr(10), string_agg(concat('[Pin #', turn, '] ', role, ': ', text), chr(10) ORDER BY turn), chr(10), '=== END PINNED MEMORIES ===', chr(10),
'IMPORTANT: The above pinned messages are persistent memories for this channel. Always keep them in mind when responding.') AS block FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id""")
def pins_block(spark, sf_dir):
    pins = table(spark, sf_dir, "conversations").where("turn % 2 = 0").select("conv_id", F.col("turn").alias("id"), F.col("role").alias("author_name"), F.col("text").alias("content"))
    return rules.pins_block(pins, "conv_id")


@query("""SELECT conv_id, CASE count(*) WHEN 1 THEN min(text) ELSE concat('New live chat messages (oldest to newest):', chr(10), string_agg(concat('- ', role, ': ', text), chr(10) ORDER BY turn), chr(10),
'Reply once to all of these in one short chat response.') END AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def live_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("author"), "text"))).alias("e"))
    entries = F.transform("e", lambda x: F.struct(x["author"].alias("author"), x["text"].alias("text")))
    return rows.select("conv_id", rules.live_prompt(entries).alias("prompt"))


@query("""SELECT o_orderkey, 9000000000000000000 + o_orderkey AS message_id, concat('[Pin #', o_orderkey, '] ', o_orderpriority) AS content, concat('Pinned memory from ', o_orderstatus) AS author,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '2024-01-01' END AS "timestamp", 'pin' AS retrieval_source, CAST(1.0 AS DOUBLE) AS retrieval_score,
concat('Persistent channel memory pinned by ', o_custkey) AS retrieval_reason FROM orders""")
def pin_context(spark, sf_dir):
    at = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("some day")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(1).alias("channel_id"), F.col("o_orderpriority").alias("content"), F.col("o_orderstatus").alias("author_name"), F.col("o_custkey").cast("string").alias("pinned_by"), at.alias("pinned_at")
    )
    out = rules.pin_context(rows, F.lit("2024-01-01").cast("timestamp"))
    return out.select((F.col("message_id") - rules.PIN_OFFSET).alias("o_orderkey"), "message_id", "content", "author", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "retrieval_source", F.col("retrieval_score").cast("double").alias("retrieval_score"), "retrieval_reason")


@query("""SELECT conv_id, turn, concat('CTX_', turn, ' [source=', role, ', score=', printf('%.3f', turn / 8.0), CASE WHEN turn % 2 = 0 THEN ', reason=even' ELSE '' END, '] ', role, ': ', text) AS line FROM conversations""")
def prompt_line(spark, sf_dir):
    line = X.prompt_line(F.concat(F.lit("CTX_"), F.col("turn").cast("string")), F.col("role"), F.col("text"), F.col("role"), F.col("turn") / 8.0, F.when(F.col("turn") % 2 == 0, "even"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))


@query("""SELECT a.conv_id, a.turn, b.role AS replied_role, length(b.text) AS replied_characters FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn * 2 - 3 WHERE a.turn > 0""")
def reply_target(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("reply_to", F.when(F.col("turn") > 0, F.col("turn") * 2 - 3))
    return windows.replied_to(rows, "conv_id", "turn", "reply_to", ["role", "text"]).select("conv_id", "turn", "replied_role", F.length("replied_text").alias("replied_characters"))


@query("""WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS t, list(turn ORDER BY turn) FILTER (turn < 2) AS v FROM conversations GROUP BY conv_id)
SELECT conv_id, i AS place, t[i + 1] AS text, v[i + 1] AS vector FROM (SELECT *, unnest(range(0, len(t))) AS i FROM a)""")
def inputs_with_vectors(spark, sf_dir):
    ordered = lambda c, keep: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", c))), keep), lambda x: x[c])
    rows = table(spark, sf_dir, "conversations").withColumn("v", F.col("turn")).groupBy("conv_id").agg(ordered("text", lambda x: F.lit(True)).alias("t"), ordered("v", lambda x: x["turn"] < 2).alias("v"))
    zipped = rows.select("conv_id", F.posexplode(windows.zip_padded(F.col("t"), F.col("v"))).alias("place", "z"))
    return zipped.select("conv_id", F.col("place").cast("bigint").alias("place"), F.col("z.input").alias("text"), F.col("z.vector").alias("vector"))


# ---- limits ------------------------------------------------------------------------------------

# the accepted times of a user, event by event: each step of the recursion takes every user's next event
GREEDY = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s(user_id, n, event_id, t, accepted, rule, acc) AS (SELECT user_id, n, event_id, t, true, CAST(0 AS BIGINT), [t] FROM e WHERE n = 1
UNION ALL SELECT user_id, n, event_id, t, rule = 0, rule, CASE WHEN rule = 0 THEN list_append(acc, t) ELSE acc END FROM (
SELECT e.user_id, e.n, e.event_id, e.t, s.acc, CASE WHEN len(list_filter(s.acc, lambda x: x {at} e.t - 3600000000)) >= {hour} THEN CAST(3600 AS BIGINT) WHEN len(list_filter(s.acc, lambda x: x {at} e.t - 86400000000)) >= {day} THEN 86400 ELSE 0 END AS rule
FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT event_id, user_id, accepted, CASE WHEN rule > 0 THEN CAST(greatest(1, (list_min(list_filter(acc, lambda x: x {at} t - rule * 1000000)) + rule * 1000000 - t) // 1000000) AS BIGINT) END AS retry_after FROM s"""


@query(GREEDY.format(at=">=", hour=2, day=6))
def limiter_greedy(spark, sf_dir):
    return limits.admitted(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", [(3600, 2), (86_400, 6)])


@query(f"SELECT event_id, user_id, accepted, CAST(greatest(1, floor(retry_after / 60.0) + 1) AS BIGINT) AS minutes FROM ({GREEDY.format(at='>', hour=1, day=1000000)})")
def image_limiter(spark, sf_dir):
    rows = limits.admitted(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", [(3600, 1)], inclusive=False)
    return rows.select("event_id", "user_id", "accepted", F.when(~F.col("accepted"), limits.retry_minutes(F.col("retry_after"))).otherwise(1).alias("minutes"))


@query("""SELECT event_id, CASE WHEN before >= 12 THEN (oldest + 3600000000 - t) / 1e6 ELSE 0.0 END AS wait FROM (SELECT event_id, t,
row_number() OVER (ORDER BY t, event_id) - 1 - count(*) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000 PRECEDING) AS before,
min(t) OVER (ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS oldest FROM (SELECT event_id, epoch_us(ts) AS t FROM events))""")
def image_waits(spark, sf_dir):
    return limits.waits(table(spark, sf_dir, "events"), "ts", "event_id", 3600, 12)


@query("""WITH a AS (SELECT user_id, min_by(event_type, event_id) AS first FROM events GROUP BY user_id) SELECT event_id FROM events JOIN a USING (user_id) WHERE first <> 'error'""")
def admitted_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    allowed = rows.groupBy("user_id").agg((F.min_by("event_type", "event_id") != "error").alias("accepted"))
    return limits.admitted_batch(rows, allowed, "user_id").select("event_id")


@query("""SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 6 HOURS""")
def stale_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return messages.not_stale(rows.groupBy("user_id").agg(F.max("ts").alias("ts")), "ts", as_of(rows, "ts"), 6 * 3600)


# ---- records -----------------------------------------------------------------------------------


@query("""SELECT row_number() OVER (ORDER BY o_orderdate, o_custkey, o_orderpriority, o_orderkey % 2 = 0) + 100 AS id, o_custkey AS reporter_id, left(concat(o_custkey, repeat('x', 120)), 100) AS reporter_name,
CASE WHEN o_orderkey % 2 = 0 THEN 'issue' ELSE 'feature' END AS report_type, trim(o_orderpriority) AS description, 'open' AS status, date_trunc('second', o_orderdate) AS created_at, date_trunc('second', o_orderdate) AS updated_at
FROM orders WHERE o_orderkey % 5 > 0""")
def new_reports(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 2 == 0, " Issue ").otherwise("FEATURE")
    text = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\n"))).otherwise(" \n")
    drafts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reporter_id"), F.concat("o_custkey", F.lit("x" * 120)).alias("reporter_name"), kind.alias("report_type"), text.alias("description"), F.col("o_orderdate").alias("at"))
    return changes.new_reports(drafts, 100)


@query("""SELECT c_custkey, n AS deleted_rows, n > 0 AS deleted FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey)""")
def deletions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.deletions(rows, table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def rows_after_deletion(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return changes.remaining(table(spark, sf_dir, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("""SELECT conv_id, count(*) AS messages, count_if((role <> 'assistant' OR turn = 1) AND length(text) % 3 > 0) AS indexed FROM conversations GROUP BY conv_id""")
def backfill_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("content", F.when(F.length("text") % 3 > 0, F.col("text")).otherwise(" \n "))
    return changes.accepted_counts(rows, ["conv_id"], "content", F.col("role") == "assistant", F.col("turn") == 1)


@query("""SELECT conv_id, count(*) AS messages, count_if((role <> 'assistant' OR turn % 4 = 1) AND trim(text) <> '') AS indexed FROM conversations QUALIFY_3 GROUP BY conv_id""".replace("FROM conversations QUALIFY_3", "FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)"))
def backfill_newest(spark, sf_dir):
    """The last three messages of each conversation; every second answer of the assistant is one's own."""
    rows = table(spark, sf_dir, "conversations").withColumnsRenamed({"text": "content", "conv_id": "channel_id"})
    history = rows.withColumns({"message_id": F.col("turn"), "created_at": F.timestamp_seconds("turn"), "is_bot": F.col("role") == "assistant", "author_id": F.when(F.col("turn") % 4 == 1, 1).otherwise(2)})
    return changes.backfill(history, own_bot=1, most=3)[1].withColumnRenamed("channel_id", "conv_id")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN ok AND c = '' THEN 'a success without content' END, CASE WHEN NOT ok AND e IS NULL THEN 'a failure without an error type' END, CASE WHEN w < 0 THEN 'a negative wait' END,
CASE WHEN u AND NOT ok THEN 'token usage of a failure' END], lambda x: x IS NOT NULL), ';') AS faults FROM (SELECT doc_id, doc_id % 3 > 0 AS ok, CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(text, '') END AS c, CASE WHEN doc_id % 2 = 0 THEN source END AS e, doc_id % 7 - 1 AS w, doc_id % 4 = 0 AS u FROM documents)""")
def response_faults(spark, sf_dir):
    d = F.col("doc_id")
    faults = rules.faults_of_response(d % 3 > 0, F.when(d % 5 == 0, F.lit("")).otherwise(F.col("text")), F.when(d % 2 == 0, F.col("source")), d % 7 - 1, d % 4 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(faults, ";").alias("faults"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size <= 5 THEN 'context.max_messages must be positive' END, CASE WHEN p_size * 50 NOT BETWEEN 100 AND 2000 THEN 'messages.split_length must be between 100 and 2000' END,
CASE WHEN p_size > 40 THEN 'generation.temperature must be between 0.0 and 2.0' END, CASE WHEN p_size % 7 = 0 OR p_size % 11 = 0 THEN 'context.context_messages_low/medium/high must all be positive' END,
CASE WHEN p_size % 7 > p_size % 11 OR p_size % 11 > 10 THEN 'context.context_messages_low <= medium <= high is required' END], lambda x: x IS NOT NULL), ';') AS faults FROM part""")
def configuration_faults(spark, sf_dir):
    """Configurations made of each part's size."""
    size = F.col("p_size")
    made = {"context.max_messages": size - 5, "messages.split_length": size * 50, "generation.temperature": size / 20.0, "context.context_messages_low": size % 7, "context.context_messages_medium": size % 11, "context.context_messages_high": F.lit(10)}
    rows = table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k.replace(".", "_")) for k, c in made.items()])
    return rows.select("p_partkey", F.array_join(rules.faults_of_config(dict.fromkeys(made, "double")), ";").alias("faults"))


@query("""SELECT user_id, concat('[', string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id), ']') AS selected_message_ids, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id""")
def retrieval_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return rows.select("user_id", X.ids_json(F.col("ids")).alias("selected_message_ids"), F.size("ids").cast("bigint").alias("n"))


@query("""SELECT vec_id, len(v) AS dimensions, round(list_sum(v), 6) AS total, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) AS weighted
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS VARCHAR) AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 3 = 0)""")
def parsed_vectors(spark, sf_dir):
    json = F.to_json("embedding")
    broken = F.when(F.col("vec_id") % 3 == 0, json).when(F.col("vec_id") % 3 == 1, F.left(json, F.length(json) - 5)).otherwise('{"a": 1}')
    rows = table(spark, sf_dir, "embeddings").select("vec_id", X.vector_of(broken).alias("v")).where("v IS NOT NULL")
    added = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    return rows.select("vec_id", F.size("v").cast("bigint").alias("dimensions"), added("v").alias("total"), added(F.transform("v", lambda x, i: x * (i + 1))).alias("weighted"))


STATE = """WITH l AS (SELECT user_id, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'content' WHEN 'view' THEN 'content' WHEN 'purchase' THEN 'ok' ELSE 'fail' END AS op, substring(props, length(props) - 1, 1) AS hash FROM events),
w AS (SELECT *, last_value(CASE WHEN op = 'content' THEN hash END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
last_value(CASE WHEN op = 'content' THEN hash END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM l),
r AS (SELECT *, CASE WHEN (op = 'content' AND before IS DISTINCT FROM hash) OR (op = 'ok' AND hash = now) THEN seq END AS reset FROM w), m AS (SELECT *, max(reset) OVER (PARTITION BY user_id) AS last FROM r),
a AS (SELECT user_id, arg_max(hash, seq) FILTER (op = 'content') AS hash, arg_max(op, reset) FILTER (reset IS NOT NULL) AS op, count_if(op = 'fail' AND seq > last) AS attempts, max(ts) FILTER (op = 'fail' AND seq > last) AS failed_at FROM m WHERE last IS NOT NULL GROUP BY user_id)
SELECT user_id, hash, CASE WHEN attempts >= 3 THEN 'failed' WHEN attempts > 0 OR op = 'content' THEN 'pending' ELSE 'done' END AS status, CAST(attempts AS INTEGER) AS attempts,
CASE WHEN attempts BETWEEN 1 AND 2 THEN failed_at + to_seconds(CAST(60 * pow(2, attempts - 1) AS BIGINT)) END AS next_retry_at, CASE WHEN attempts > 0 THEN 'no vector' END AS last_error FROM a"""


@query(STATE)
def embedding_state(spark, sf_dir):
    op = F.create_map(*[F.lit(x) for p in {"click": "content", "view": "content", "purchase": "ok", "error": "fail", "signup": "fail"}.items() for x in p])[F.col("event_type")]
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), "user_id", F.substring("props", -2, 1).alias("hash"), F.col("ts").alias("at"), F.lit("no vector").alias("error"))
    return changes.embedding_state(log, "user_id")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_tax - 0.02 >= 0 AND l_discount - 0.01 >= 0""")
def valid_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"input_tokens": F.col("l_tax") - 0.02, "output_tokens": F.col("l_discount") - 0.01, "total_tokens": F.col("l_quantity")})
    return usage.valid_usage(rows).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'assistant' OR conv_id = 5")
def humans_and_own_bot(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("is_bot", F.col("role") == "assistant")
    return messages.humans_and(rows, 5, "is_bot", "conv_id").select("conv_id", "turn")


@query("SELECT event_id FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_of_guild(spark, sf_dir):
    rows = messages.in_scope(table(spark, sf_dir, "events"), guild=5, channel="click", cross_channel=True, guild_col="user_id", channel_col="event_type")
    return messages.recent(rows, "ts", "event_id", 30).select("event_id")


@query("""SELECT conv_id, turn, array_to_string(list_filter(['author is empty', 'message id isn''t positive', 'channel id isn''t positive', 'a reply without its target', 'a target without a reply'],
lambda x, i: [role = 'system', turn <= 0, conv_id <= 0, turn % 3 = 1 AND turn % 2 = 0, NOT (turn % 3 = 1) AND turn % 2 = 1][i]), '; ') AS faults FROM conversations""")
def message_faults(spark, sf_dir):
    author, target = F.when(F.col("role") != "system", F.col("role")), F.when(F.col("turn") % 2 == 1, F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(rules.faults_of_message(author, F.col("turn"), F.col("conv_id"), F.col("turn") % 3 == 1, target), "; ").alias("faults"))


@query("""SELECT p_partkey, array_to_string(list_filter(['a negative count', 'total below its parts'], lambda x, i: [p_size - 3 < 0, p_size * 2 < p_size - 3 + 30][i]), '; ') AS faults,
CASE WHEN p_size - 3 > 0 AND p_size - 3 <= 20 AND 20 <= p_size THEN true ELSE false END AS in_order FROM part""")
def usage_faults(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rules.faults_of_usage(size - 3, F.lit(30), size * 2), "; ").alias("faults"), rules.limits_in_order(size - 3, F.lit(20), size).alias("in_order"))


@query("""SELECT p_partkey, array_to_string(list_filter(['too large', 'format not supported', 'too small', 'warning: large'], lambda x, i: [p_size > 40, p_brand NOT IN ('Brand#1', 'Brand#2'), p_size < 32 OR p_size * 3 < 32, p_size > 4096 OR p_size * 100 > 4096][i]), '; ') AS faults,
CASE WHEN p_size * 100 > 4096 THEN 'wide' END AS mark FROM part""")
def image_faults(spark, sf_dir):
    size = F.col("p_size")
    height = F.when(size * 100 > 4096, size * 100).otherwise(size * 3)
    faults = rules.image_faults(size, F.upper("p_brand"), size, height, 40, ["brand#1", "brand#2"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(faults, "; ").alias("faults"), F.when(size * 100 > 4096, "wide").alias("mark"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'image' WHEN p_size % 3 = 1 THEN 'audio' ELSE CASE p_size % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'other' END END AS kind FROM part""")
def media_kind(spark, sf_dir):
    given = F.when(F.col("p_size") % 3 == 0, "image/tiff").when(F.col("p_size") % 3 == 1, "audio/x-odd").when(F.col("p_size") % 2 == 0, "text/plain")
    ending = F.when(F.col("p_size") % 5 == 0, ".PNG").when(F.col("p_size") % 5 == 1, ".ogg").otherwise(".exe")
    return table(spark, sf_dir, "part").select("p_partkey", rules.media_kind(F.concat("p_name", ending), given).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN c = 'high' OR (c <> 'medium' AND t = 'high') THEN 'high' WHEN c = 'medium' OR t IN ('low', 'medium') THEN 'medium' ELSE 'low' END AS tier,
CASE WHEN t IN ('low', 'medium', 'high') THEN 120 WHEN t = '' AND p_size % 2 = 0 THEN 120 ELSE 30 END AS seconds
FROM (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'low' END AS c, CASE p_size % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'minimal' ELSE '' END AS t FROM part)""")
def request_tiers(spark, sf_dir):
    size = F.col("p_size")
    complexity = F.when(size % 4 == 0, " HIGH").when(size % 4 == 1, "medium").when(size % 4 == 2, "Low")
    thinking = F.when(size % 5 == 0, "High").when(size % 5 == 1, "low").when(size % 5 == 2, "medium").when(size % 5 == 3, "minimal")
    mode = F.when(size % 2 == 0, "thinking").otherwise("short")
    return table(spark, sf_dir, "part").select("p_partkey", rules.output_tier(complexity, thinking).alias("tier"), rules.timeout_seconds(thinking, mode).alias("seconds"))


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 7 ELSE 0 END AS reason FROM part""")
def finish_reason(spark, sf_dir):
    names = ["FinishReason.STOP", "max_tokens", "SAFETY", "blocklist", "RECITATION", "OTHER", "7", "what"]
    name = F.element_at(F.array(*map(F.lit, names)), F.col("p_size") % 8 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", rules.finish_reason(name).cast("int").alias("reason"))


@query("SELECT * FROM (VALUES ('free', 15, 1500, 1000000), ('paid', 2000, NULL, 4000000)) AS t(tier, requests_per_minute, requests_per_day, tokens_per_minute)")
def quotas(spark, sf_dir):
    return rules.quotas(spark)


@query("""SELECT conv_id, turn, role = 'system' OR coalesce(turn = 3, false) OR turn % 4 = 1 OR turn % 5 = 2 AS addressed FROM conversations""")
def addressed(spark, sf_dir):
    mentions = F.when(F.col("turn") % 4 == 1, F.array(F.lit(8), F.lit(99))).otherwise(F.array(F.lit(8))).cast("array<bigint>")
    roles = F.when(F.col("turn") % 5 == 2, F.array(F.lit(41))).cast("array<bigint>")
    reply = F.when(F.col("turn") == 3, F.lit(99)).when(F.col("turn") == 4, F.lit(98))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.is_addressed(F.col("role") == "system", reply, mentions, roles, 99, [40, 41]).alias("addressed"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN n_regionkey = 1 THEN n_name END, r_name, 'default') AS model
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def pref_precedence(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    request, user = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise(" "), F.when(F.col("n_regionkey") == 1, F.col("n_name"))
    return rows.select("c_custkey", rules.first_given(request, user, F.col("r_name"), default=F.lit("default")).alias("model"))


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(s, 'none') AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def lookup_with_default(spark, sf_dir):
    state = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderstatus").alias("status"))
    return messages.looked_up(table(spark, sf_dir, "customer").select("c_custkey"), state, ["c_custkey"], {"orders": 0, "status": "none"})


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(doc_id, ',7') WHEN 1 THEN concat(doc_id, ',9') WHEN 2 THEN '3' END AS ids FROM documents""")
def json_ids(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    json = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("["), i, F.lit(', "7", "x", null]'))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("[["), i, F.lit(", 9], [1]]"))).when(F.col("doc_id") % 4 == 2, "[3]").otherwise("no list")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rules.json_ids(json).cast("array<string>"), ",").alias("ids"))


@query("""SELECT page_id, len(s) AS sources, array_to_string(list_transform(s, lambda x: coalesce(x, '-')), ' ') AS uris FROM (SELECT page_id, list_filter([url, CASE WHEN page_id % 2 = 0 THEN 'b' END], lambda x: x IS NOT NULL) AS s FROM pages)""")
def grounding_sources(spark, sf_dir):
    chunk = lambda uri, title: F.struct(F.struct(uri.alias("uri"), title.alias("title")).alias("web"))
    chunks = F.array(chunk(F.col("url"), F.lit("t")), chunk(F.when(F.col("page_id") % 2 == 0, "b"), F.lit("u")))
    found = rules.grounding_sources(chunks)
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("bigint").alias("sources"), F.array_join(F.transform(found, lambda s: s["uri"]), " ").alias("uris"))


@query(r"""SELECT conv_id, turn, left(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 200) AS key FROM conversations""")
def router_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.router_key(F.col("text")).alias("key"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'In Progress' WHEN 'O' THEN 'Open' ELSE 'Declined' END AS label FROM orders""")
def status_label(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "in_progress").when(F.col("o_orderstatus") == "O", "open").otherwise("declined")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.status_label(status).alias("label"))


@query("""SELECT doc_id, concat(source, ' (', CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'unknown' END, '), ', CASE WHEN doc_id % 3 = 0 THEN 'b.txt' ELSE 'attachment' END, ' (text/plain)') AS summary,
concat(CASE WHEN doc_id % 5 = 0 THEN 'said' ELSE 'joined' END, ' [Message type: default | Attached images: ', source, ' | Attached files: b.txt', CASE WHEN doc_id % 4 > 0 THEN concat(' | Embeds: ', doc_id % 4) ELSE '' END,
CASE WHEN doc_id % 2 = 0 THEN ' | Stickers: wave' ELSE ' | Stickers: 1' END, ' | Forwarded[1]: ', left(text, 180), CASE WHEN length(trim(text)) > 180 THEN '...' ELSE '' END, ']') AS content
FROM documents WHERE left(trim(text, ' '), 180) = left(text, 180) AND trim(text, ' ') <> ''""")
def message_contents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("left(trim(text), 180) = left(text, 180) AND trim(text) != ''")
    file = lambda name, kind: F.struct(name.alias("filename"), kind.alias("content_type"))
    even = F.col("doc_id") % 2 == 0
    summary = X.attachment_summary(F.array(file(F.col("source"), F.when(even, F.col("lang"))), file(F.when(F.col("doc_id") % 3 == 0, "b.txt"), F.lit("text/plain"))))
    snapshot = F.struct(F.col("text").alias("content"), F.lit("default").alias("kind"), F.lit(1).alias("attachments"), F.lit(0).alias("embeds"), F.lit(0).alias("stickers"))
    files = F.array(file(F.col("source"), F.lit("image/png")), file(F.lit("b.txt"), F.lit(None).cast("string")))
    content = X.message_content(F.when(F.col("doc_id") % 5 == 0, " said"), F.lit("joined "), F.lit("default"), files, (F.col("doc_id") % 4).cast("int"), F.array(F.when(even, "wave")), F.array(snapshot))
    return rows.select("doc_id", summary.alias("summary"), content.alias("content"))


@query("""SELECT doc_id, source AS title, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, source) AS rank FROM (SELECT d.doc_id, s.source,
2 * CAST(contains(lower(d.lang || ' ' || d.source), s.source) AS INTEGER) + CASE WHEN contains(lower(d.lang || ' ' || d.source), s.source) THEN 3 ELSE 0 END + 0.5 * CAST(s.source = d.source AS INTEGER)
+ CAST(contains(lower(d.lang || ' ' || d.source), d.lang) AND d.lang = 'en' AS INTEGER) AS score FROM (SELECT doc_id, lang, source FROM documents) d, (SELECT DISTINCT source FROM documents) s) WHERE score > 0""")
def help_relevance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sections = docs.select("source").distinct().select(F.col("source").alias("title"), F.array("source").alias("keywords"), F.col("source").alias("content"), F.array(F.lit("en")).alias("examples"))
    scored = suggestions.help_scores(docs.select("doc_id", F.concat_ws(" ", "lang", "source").alias("query")).select("query").distinct(), sections)
    both = docs.select("doc_id", F.concat_ws(" ", "lang", "source").alias("query")).join(scored, "query")
    return both.select("doc_id", "title", F.col("score").cast("double").alias("score"), F.col("rank").cast("bigint").alias("rank"))


# ---- markup ------------------------------------------------------------------------------------

EXPRESSION = r"""concat('\frac{\alpha_', doc_id % 10, '}{x^{', n_chars, '-\beta}} \cdot ', CASE doc_id % 4 WHEN 0 THEN '\int_a^b ' WHEN 1 THEN '\unknown ' WHEN 2 THEN '\cdots \leq y_{ij}^{2n} ' ELSE '' END, source)"""
SYMBOLS = r"""MAP {'\alpha': 'α', '\beta': 'β', '\in': '∈', '\leq': '≤', '\cdot': '·', '\int': '∫'}"""


@query(rf"""WITH e AS (SELECT doc_id, {EXPRESSION} AS e FROM documents),
a AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(e, '\\(?:alpha|beta|cdot|leq|in)|[^\\]+|\\'), lambda p: coalesce(map_extract_value({SYMBOLS}, p), p)), '') AS e FROM e),
b AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(e, '\^\{{[^}}]+\}}|\^[0-9a-zA-Z]|[^\^]+|\^'), lambda p: CASE WHEN p[1] = '^' AND length(p) > 1 THEN translate(regexp_replace(p, '^.\{{?|\}}$', '', 'g'), '0123456789-nbi', '⁰¹²³⁴⁵⁶⁷⁸⁹⁻ⁿᵇⁱ') ELSE p END), '') AS e FROM a),
c AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(e, '_\{{[^}}]+\}}|_[0-9a-zA-Z]|[^_]+|_'), lambda p: CASE WHEN p[1] = '_' AND length(p) > 1 THEN translate(regexp_replace(p, '^.\{{?|\}}$', '', 'g'), '0123456789aij', '₀₁₂₃₄₅₆₇₈₉ₐⱼⱼ') ELSE p END), '') AS e FROM b),
d AS (SELECT doc_id, regexp_replace(e, '\\frac\{{([^}}]*)\}}\{{([^}}]*)\}}', '(\1)/(\2)', 'g') AS e FROM c)
SELECT doc_id, CASE WHEN NOT regexp_matches(e, '\\[a-zA-Z]') THEN replace(replace(e, '{{', ''), '}}', '') END AS plain FROM d""")
def latex_unicode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('\\\\frac{\\\\alpha_', doc_id % 10, '}{x^{', n_chars, '-\\\\beta}} \\\\cdot ', CASE doc_id % 4 WHEN 0 THEN '\\\\int_a^b ' WHEN 1 THEN '\\\\unknown ' WHEN 2 THEN '\\\\cdots \\\\leq y_{ij}^{2n} ' ELSE '' END, source)").alias("e"))
    return markup.latex_to_unicode(rows, "doc_id", "e")


@query(r"""SELECT doc_id, concat('\mathrm{', source, '} \Rightarrow ( x y ) \mathrm{gcd} \mathrm{R} ∴ a b') AS cleaned, doc_id % 2 = 0 AS raw FROM documents""")
def latex_cleaned(spark, sf_dir):
    e = F.concat(F.lit("\\text{"), F.col("source"), F.lit("}  \\implies \\left( x & y \\right) \\gcd \\mathbb{R} \\therefore \\begin{aligned}a\n b\\end{aligned}"))
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("so \\sqrt{2} and "), F.col("source"))).otherwise(F.concat(F.lit("plain \\word "), F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", markup.clean_latex(e).alias("cleaned"), markup.has_raw_latex(line).alias("raw"))


@query(r"""SELECT doc_id, place, CASE WHEN place < 2 THEN place + 1 WHEN place = 3 THEN 3 END AS number, e[place + 1] AS expression, CASE WHEN place = 2 THEN 'x₂' END AS plain
FROM (SELECT doc_id, unnest(range(0, 4)) AS place, ['a + b', source, 'x_2', '\foo y'] AS e FROM documents)""")
def latex_equations(spark, sf_dir):
    text = F.concat(F.lit("see $x_2$ and $$ a + b $$ or $\\foo y$, then $$"), F.col("source"), F.lit("$$ $$ $$"))
    found = markup.equations(table(spark, sf_dir, "documents").select("doc_id", text.alias("t")), "doc_id", "t")
    return found.select("doc_id", F.col("place").cast("bigint").alias("place"), F.col("number").cast("bigint").alias("number"), "expression", "plain")


@query(r"""SELECT p_partkey, concat('```', chr(10), rpad('name', w, ' '), ' | ', rpad('b', v, ' '), chr(10), repeat('-', w), '-+-', repeat('-', v), chr(10), rpad(p_name, w, ' '), ' | ', rpad(p_brand, v, ' '), chr(10), rpad('x', w, ' '), ' | ', rpad('', v, ' '), chr(10), rpad('', w, ' '), ' | ', rpad('y', v, ' '), chr(10), '```') AS block
FROM (SELECT *, CAST(greatest(4, length(p_name)) AS INTEGER) AS w, CAST(greatest(1, length(p_brand)) AS INTEGER) AS v FROM part)""")
def table_code_block(spark, sf_dir):
    text = F.concat(F.lit("| name | b |\n|:---|---:|\n| "), F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit(" |\n| x |\n|| y |\n"))
    return markup.table_blocks(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")


@query(r"""SELECT doc_id, doc_id % 3 > 0 AND regexp_replace(text, '^\s+|\s+$', '', 'g') = text OR (doc_id % 3 = 0 AND substring(text, 1, 500) = '' AND trim(text) = '') AS intact FROM documents""")
def split_intact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(X.hard_split(F.col("text"), 500)).alias("part", "piece"))
    noted = F.when(F.col("part") > 0, F.concat(F.lit("*(continued from part 1/9)*\n\n"), "piece")).otherwise(F.concat("piece", F.lit("\n\n*(continues in part 2/9)*")))
    changed = F.when((F.col("doc_id") % 3 == 0) & (F.col("part") == 0) & (F.col("piece") != ""), F.concat(F.lit("!"), noted)).otherwise(noted)
    return markup.intact(parts.select("doc_id", "part", changed.alias("piece")), docs, "doc_id", "part", "piece", "text")
