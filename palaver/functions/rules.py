"""Decisions and records as column expressions: addressing, tiers, quotas, validation, context rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def is_addressed(is_direct: Column, reply_to: Column, mentions: Column, roles: Column, bot: int, bot_roles: list[int]) -> Column:
    """A direct message, a reply to the bot, a mention of it, or of a role it has (never everyone)."""
    shared = F.arrays_overlap(roles, F.array(*map(F.lit, bot_roles)).cast("array<bigint>")) if bot_roles else F.lit(False)
    parts = [is_direct, reply_to == bot, F.array_contains(mentions, F.lit(bot).cast("bigint")), shared]
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts])


def first_given(*columns: Column, default: Column) -> Column:
    """Precedence look-up: request, user, runtime, then what the complexity implies."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], default)


def timeout_seconds(thinking: Column, mode: Column | None = None, usual: int = 30, extended: int = 120) -> Column:
    """Longer where the level of thinking is; without a level the prompt mode implies one."""
    implied = F.when(mode == "thinking", "high") if mode is not None else F.lit(None).cast("string")
    return F.when(F.lower(F.coalesce(thinking, implied)).isin("low", "medium", "high"), extended).otherwise(usual)


def output_tier(complexity: Column, thinking: Column) -> Column:
    """low, medium or high; thinking raises the tier but doesn't lower it."""
    level, deep = F.lower(F.trim(F.coalesce(complexity, F.lit("low")))), F.lower(F.coalesce(thinking, F.lit("")))
    return F.when((level == "high") | ((level != "medium") & (deep == "high")), "high").when((level == "medium") | deep.isin("low", "medium"), "medium").otherwise("low")


# Finish reasons by number; the first substring that matches counts.
FINISH_REASONS = [("STOP", 1), ("MAX_TOKENS", 2), ("SAFETY", 3), ("PROHIBITED", 3), ("BLOCK", 3), ("SPII", 3), ("RECITATION", 4), ("OTHER", 5)]


def finish_reason(reason: Column) -> Column:
    name = F.upper(reason.cast("string"))
    case = F.when(name.rlike(r"^\d+$"), name.try_cast("int"))
    for text, number in FINISH_REASONS:
        case = case.when(name.contains(text), number)
    return F.coalesce(case, F.lit(0))


# Request quotas by tier (requests a minute and a day, tokens a minute).
QUOTAS = [("free", 15, 1500, 1_000_000), ("paid", 2000, None, 4_000_000)]


def quotas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUOTAS, "tier string, requests_per_minute int, requests_per_day int, tokens_per_minute int")


def faults_of_message(author: Column, message_id: Column, channel_id: Column, is_reply: Column, replied_to: Column) -> Column:
    """The rules that a context row breaks, as an array of texts."""
    rules = [
        (F.coalesce(author, F.lit("")) == "", "author is empty"),
        (message_id <= 0, "message id isn't positive"),
        (channel_id <= 0, "channel id isn't positive"),
        (is_reply & replied_to.isNull(), "a reply without its target"),
        (~is_reply & replied_to.isNotNull(), "a target without a reply"),
    ]
    return _faults(rules)


def _faults(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))


def _empty(value: Column) -> Column:
    """Null, or without characters or bytes."""
    return F.coalesce(F.length(value) == 0, F.lit(True))


def faults_of_usage(inputs: Column, outputs: Column, total: Column) -> Column:
    negative = (inputs < 0) | (outputs < 0) | (total < 0)
    return _faults([(negative, "a negative count"), (total < inputs + outputs, "total below its parts")])


def faults_of_response(success: Column, content: Column, error_type: Column, retry_after: Column, has_usage: Column) -> Column:
    """Of a model's answer: what it must have, by whether it succeeded."""
    return _faults([
        (success & _empty(content), "a success without content"), (~success & _empty(error_type), "a failure without an error type"),
        (retry_after < 0, "a negative wait"), (has_usage & ~success, "token usage of a failure"),
    ])


def faults_of_edit_request(user_id: Column, image: Column, instruction: Column, channel_id: Column) -> Column:
    """Of an order to edit an image; an instruction of white space is none."""
    return _faults([(_empty(user_id), "no user"), (_empty(image), "no image"), (_empty(F.regexp_replace(instruction, r"(?U)^\s+|\s+$", "")), "no instruction"), (_empty(channel_id), "no channel")])


def faults_of_edit_result(success: Column, image: Column, error: Column, seconds: Column) -> Column:
    return _faults([(success & _empty(image), "a success without an image"), (~success & _empty(error), "a failure without a message"), (seconds < 0, "a negative time")])


def faults_of_validation(valid: Column, error: Column, megabytes: Column, width: Column, height: Column) -> Column:
    return _faults([(~valid & _empty(error), "invalid without a message"), (megabytes < 0, "a negative size"), ((width <= 0) | (height <= 0), "no dimensions")])


def limits_in_order(low: Column, medium: Column, high: Column) -> Column:
    """Whether three tier limits are positive and don't fall."""
    return (low > 0) & (low <= medium) & (medium <= high)


# Rules of the configuration by key.  Numbers that must be positive, that mustn't be negative,
# and that have a least and a greatest value; texts that mustn't be empty; limits by tier.
POSITIVE = ["context.max_messages", "context.reply_range", "response.timeout", "image_processing.max_size_mb", "image_processing.timeout", "image_processing.max_concurrent_edits", "messages.split_length", "generation.max_output_tokens", "models.router_cache_size", "models.router_cache_ttl", "validation.max_pdf_pages"]
NOT_NEGATIVE = ["context.max_images", "response.max_retries"]
RANGES = [("reports.web_port", 1, 65535), ("messages.split_length", 100, 2000), ("ux.command_suggestion_threshold", 0.0, 1.0), ("generation.temperature", 0.0, 2.0)]
AT_MOST = [("image_processing.max_size_mb", 25), ("image_processing.timeout", 300), ("image_processing.max_concurrent_edits", 10)]
FILLED = ["bot.token_db_path", "reports.web_host", "nano_banana.model", "system_prompts.high_complexity", "system_prompts.medium_complexity", "system_prompts.low_complexity", "models.default", "models.router"]
TIERED = ["context.context_messages", "generation.max_output_tokens"]
RAG_POSITIVE = ["rag.lexical_candidates", "rag.semantic_candidates", "rag.recency_half_life_hours", "rag.max_context_messages_low", "rag.max_context_messages_medium", "rag.max_context_messages_high"]
RAG_NOT_NEGATIVE = ["rag.backfill_limit", "rag.rerank_candidates"]
THINKING_BACKENDS = ["thinking_level", "thinking_budget", "none"]
THINKING_LEVELS = ["default", "off", "minimal", "low", "medium", "high", "none", "inherit", "disabled"]


def faults_of_config(settings: dict[str, str]) -> Column:
    """The rules that a configuration row breaks, as an array of texts; ``settings`` has the columns' types by key.

    A key's column has its name with underscores for dots.  Rules of keys that the row doesn't have
    are left out; null breaks the rule of a key that it has.  ``models.valid`` and ``models.available``
    are arrays, ``models.thinking_backend`` a map by model, ``model_complexity`` a map by tier of structs
    with model and thinking_level.
    """
    col = lambda key: F.col(key.replace(".", "_"))
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    trimmed = lambda key: F.regexp_replace(col(key), r"(?U)^\s+|\s+$", "")
    have = lambda *keys: all(k in settings for k in keys)
    rules = [(broken(col(k) > 0), f"{k} must be positive") for k in POSITIVE if have(k)]
    rules += [(broken(col(k) >= 0), f"{k} must be zero or positive") for k in NOT_NEGATIVE if have(k)]
    rules += [(broken(col(k).between(a, b)), f"{k} must be between {a} and {b}") for k, a, b in RANGES if have(k)]
    rules += [(broken(col(k) <= b), f"{k} must be at most {b}") for k, b in AT_MOST if have(k)]
    rules += [(_empty(trimmed(k)), f"{k} must not be empty") for k in FILLED if have(k)]
    for k in TIERED:
        names = [f"{k}_{tier}" for tier in ("low", "medium", "high")]
        if have(*names):
            low, medium, high = map(col, names)
            rules += [(broken((low > 0) & (medium > 0) & (high > 0)), f"{k}_low/medium/high must all be positive"), (broken((low <= medium) & (medium <= high)), f"{k}_low <= medium <= high is required")]
    if have("rag.enabled"):
        on = F.coalesce(col("rag.enabled"), F.lit(False))
        rules += [(on & broken(col(k) > 0), f"{k} must be positive") for k in RAG_POSITIVE if have(k)]
        rules += [(on & broken(col(k) >= 0), f"{k} must be zero or positive") for k in RAG_NOT_NEGATIVE if have(k)]
        rules += [(on & _empty(col(k)), f"{k} must not be empty") for k in ["rag.embedding_model"] if have(k)]
    if have("models.valid"):
        valid = F.coalesce(col("models.valid"), F.array().cast("array<string>"))
        unknown = lambda names: F.exists(names, lambda x: ~F.coalesce(F.array_contains(valid, F.trim(x)), F.lit(False)))
        rules += [(F.size(valid) == 0, "models.valid must contain at least one model")]
        rules += [(~_empty(col(k)) & ~F.array_contains(valid, col(k)), f"{k} must be one of models.valid") for k in ("models.default", "models.router") if have(k)]
        if have("models.available"):
            rules += [(unknown(col("models.available")), "models.available values must all exist in models.valid")]
        if have("models.thinking_backend"):
            names, kinds = F.map_keys(col("models.thinking_backend")), F.map_values(col("models.thinking_backend"))
            rules += [
                (unknown(names), "models.thinking_backend keys must be present in models.valid"), (F.exists(kinds, lambda x: ~F.lower(F.trim(x)).isin(THINKING_BACKENDS)), "models.thinking_backend values must be known"),
                (F.size(F.array_except(valid, names)) > 0, "models.thinking_backend is missing model entries"),
            ]
        for tier in ("high", "low", "medium") if have("model_complexity") else ():
            entry = F.try_element_at(col("model_complexity"), F.lit(tier))
            rules += [
                (entry.isNull(), f"model_complexity is missing {tier}"), (entry.isNotNull() & broken(F.array_contains(valid, F.trim(entry["model"]))), f"model_complexity.{tier}.model must be one of models.valid"),
                (entry.isNotNull() & broken(F.lower(F.trim(entry["thinking_level"])).isin(THINKING_LEVELS)), f"model_complexity.{tier}.thinking_level must be known"),
            ]
    minute, hour = "rate_limiting.text_rate_limit_per_minute", "rate_limiting.text_rate_limit_per_hour"
    if have(minute, hour):
        rules += [(broken((col(minute) > 0) & (col(hour) > 0)), f"{minute}/hour must be positive"), (col(minute) > col(hour), f"{minute} cannot exceed text_rate_limit_per_hour")]
    return _faults(rules)


def json_ids(json: Column) -> Column:
    """Ids of a JSON list, or of the first list in a list of lists; what isn't a number is left out."""
    flat = F.from_json(json, "array<string>")
    nested = F.get(F.from_json(json, "array<array<string>>"), F.lit(0))
    chosen = F.when(F.trim(json).startswith("[["), nested).otherwise(flat)
    return F.array_compact(F.transform(chosen, lambda x: x.try_cast("bigint")))


def grounding_sources(chunks: Column) -> Column:
    """(uri, title) of array<struct<web: struct<uri, title>>>, without chunks that name no page."""
    named = F.filter(chunks, lambda c: c["web"]["uri"].isNotNull())
    return F.transform(named, lambda c: F.struct(c["web"]["uri"].alias("uri"), c["web"]["title"].alias("title")))


#: Pins get message ids of their own beyond this one.
PIN_OFFSET = 9_000_000_000_000_000_000


def pin_context(pins: DataFrame, as_of: Column) -> DataFrame:
    """Pins (id, channel_id, content, author_name, pinned_by, pinned_at text) as context rows."""
    label = F.concat(F.lit("[Pin #"), F.col("id").cast("string"), F.lit("] "), "content")
    return pins.select(
        (F.lit(PIN_OFFSET) + F.col("id")).alias("message_id"), "channel_id", label.alias("content"),
        F.concat(F.lit("Pinned memory from "), "author_name").alias("author"),
        F.coalesce(F.try_to_timestamp("pinned_at"), as_of).alias("timestamp"), F.lit("pin").alias("retrieval_source"), F.lit(1.0).alias("retrieval_score"),
        F.concat(F.lit("Persistent channel memory pinned by "), "pinned_by").alias("retrieval_reason"),
    )


def numbered_lines(rows: DataFrame, by: str, order: list[str], line: Column) -> DataFrame:
    """One text block for each group: its lines in order (pins for a prompt, live chat entries)."""
    keyed = rows.select(by, F.struct(*order, line.alias("line")).alias("l"))
    return keyed.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("block"), F.count(F.lit(1)).alias("lines"))


# Texts around the lists of a prompt.
LIVE_HEAD, LIVE_FOOT = "New live chat messages (oldest to newest):\n", "\nReply once to all of these in one short chat response."
PINS_HEAD, PINS_FOOT = "=== PINNED MEMORIES FOR THIS CHANNEL ===\n", "\n=== END PINNED MEMORIES ===\n"
PINS_NOTE = "IMPORTANT: The above pinned messages are persistent memories for this channel. Always keep them in mind when responding."


def live_prompt(entries: Column) -> Column:
    """array<struct<author, text>>: one entry as it is, more as a list."""
    lines = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["author"], F.lit(": "), e["text"])), "\n")
    listed = F.concat(F.lit(LIVE_HEAD), lines, F.lit(LIVE_FOOT))
    return F.when(F.size(entries) == 0, "").when(F.size(entries) == 1, F.get(entries, F.lit(0))["text"]).otherwise(listed)


def pins_block(pins: DataFrame, by: str) -> DataFrame:
    """A group's pins (id, author_name, content) as the block that a prompt begins with; groups without pins have none."""
    line = F.concat(F.lit("[Pin #"), F.col("id").cast("string"), F.lit("] "), "author_name", F.lit(": "), "content")
    return numbered_lines(pins, by, ["id"], line).select(by, F.concat(F.lit(PINS_HEAD), "block", F.lit(PINS_FOOT + PINS_NOTE)).alias("block"))


def image_entry(kind: Column, message_id: Column, sent: Column, author: Column, name: Column, index: Column, page: Column) -> Column:
    """What ties an image to its message; ``pdf_page_number`` is null for what isn't a page."""
    fields = {"source_type": kind, "source_message_id": message_id, "source_timestamp": F.date_format(sent, "yyyy-MM-dd'T'HH:mm:ssXXX"), "source_author": author, "attachment_name": name, "attachment_index": index, "pdf_page_number": page}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def image_order(rows: DataFrame, by: list[str], at: str, message: str, index: str, page: str) -> DataFrame:
    """Images numbered from 1 by time, message, attachment and page."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(at, message, index, F.coalesce(page, F.lit(0)))))


# Image and audio files by ending.
MEDIA_ENDINGS = {"png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "mp3": "audio", "wav": "audio", "ogg": "audio", "m4a": "audio", "flac": "audio"}


def media_kind(filename: Column, content_type: Column) -> Column:
    """image, audio or other, by the type that is given, else by the ending."""
    ending = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    given = F.regexp_extract(F.coalesce(content_type, F.lit("")), "^(image|audio)/", 1)
    return F.coalesce(F.nullif(given, F.lit("")), F.create_map(*[F.lit(x) for p in MEDIA_ENDINGS.items() for x in p])[ending], F.lit("other"))


def image_faults(size: Column, kind: Column, width: Column, height: Column, most_bytes: int, kinds: list[str]) -> Column:
    rules = [(size > most_bytes, "too large"), (~F.lower(kind).isin(kinds), "format not supported"), ((width < 32) | (height < 32), "too small"), ((width > 4096) | (height > 4096), "warning: large")]
    return _faults(rules)
