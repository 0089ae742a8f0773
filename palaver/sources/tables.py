"""Schemas of the message tables, and readers that evolve additively."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "message_index": "message_id bigint, guild_id bigint, channel_id bigint, author_id bigint, author_name string, is_bot boolean, reply_to_message_id bigint, created_at timestamp, indexed_at timestamp, content_text string, attachment_summary string, content_hash string, hidden boolean, deleted_at timestamp",
    "message_embeddings": "message_id bigint, embedding_model string, embedding_vector array<double>, embedding_status string, content_hash string, embedded_at timestamp, last_error string, embedding_attempts int, next_retry_at timestamp",
    "retrieval_events": "id bigint, created_at timestamp, guild_id bigint, channel_id bigint, user_id bigint, query_length int, selected_message_ids array<bigint>, fallback_reason string, latency_ms int",
    "token_usage": "id bigint, user_id bigint, username string, guild_id bigint, guild_name string, input_tokens bigint, output_tokens bigint, total_tokens bigint, created_at timestamp",
    "reports": "id bigint, guild_id bigint, channel_id bigint, reporter_id bigint, reporter_name string, report_type string, description string, status string, admin_notes string, created_at timestamp, updated_at timestamp",
    "pinned_messages": "id bigint, channel_id bigint, guild_id bigint, content string, author_name string, pinned_by string, pinned_at timestamp, message_id bigint",
    "channel_settings": "channel_id bigint, personality string, live_enabled boolean, updated_at timestamp",
    "user_preferences": "user_id bigint, preferred_model string, preferred_language string, created_at timestamp, updated_at timestamp",
    "hidden_messages": "message_id bigint, channel_id bigint, guild_id bigint, original_content string, hidden_by string, hidden_at timestamp",
}

#: What a column added later holds in older files.
DEFAULTS: dict[str, Column | object] = {"attachment_summary": "", "hidden": False, "is_bot": False, "embedding_attempts": 0, "embedding_status": "pending", "personality": "default", "live_enabled": False, "status": "open"}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read Parquet of any age: columns that a file lacks are null, or their default."""
    rows = spark.read.schema(schema_of(name)).parquet(path)
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in rows.columns})


def conform(rows: DataFrame, name: str) -> DataFrame:
    """Bring rows to a table's columns and types; missing columns get null or their default."""
    fields = schema_of(name).fields
    column = lambda f: F.col(f.name) if f.name in rows.columns else F.lit(DEFAULTS.get(f.name))
    return rows.select(*[column(f).cast(f.dataType).alias(f.name) for f in fields])


# Endings and types of files that are read as text, and their greatest size.
TEXT_ENDINGS = ["txt", "md", "json", "yaml", "yml", "xml", "csv", "log", "ini", "cfg", "conf", "py", "js", "ts", "java", "c", "cpp", "h", "hpp", "cs", "go", "rs", "html", "css", "jsx", "tsx", "vue", "php", "rb", "sh", "bash", "ps1", "sql", "r", "m", "swift", "kt", "scala", "pl", "lua", "dart"]
TEXT_TYPES = ["json", "xml", "yaml"]
TEXT_BYTES = 5 * 1024 * 1024
IMAGE_TYPES = ["image/png", "image/jpeg", "image/gif", "image/webp"]
IMAGE_ENDINGS = ["png", "jpg", "jpeg", "gif", "webp", "bmp"]


def ending_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def is_text(name: Column, content_type: Column, endings: list[str] = TEXT_ENDINGS) -> Column:
    """Whether an attachment is read as text: by its ending or its type, unless it is an image or a PDF."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    other = kind.startswith("image/") | (kind == "application/pdf") | (ending_of(name) == "pdf")
    typed = kind.startswith("text/")
    for word in TEXT_TYPES:
        typed = typed | kind.contains(word)
    return ~other & (ending_of(name).isin(endings) | typed)


def _files(spark: SparkSession, path: str, types: DataFrame | None) -> DataFrame:
    """Files with the content type that ``types`` (path, content_type) gives them, null without it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("content_type", F.lit(None).cast("string")) if types is None else files.join(types.select("path", "content_type"), "path", "left")


def read_text_files(spark: SparkSession, path: str, endings: list[str] = TEXT_ENDINGS, largest: int = TEXT_BYTES, types: DataFrame | None = None) -> DataFrame:
    """(path, text) of small text files: UTF-8, or Latin-1 where the bytes aren't valid UTF-8."""
    files = _files(spark, path, types).where(is_text(F.col("path"), F.col("content_type"), endings) & (F.col("length") <= largest))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("text"))


def image_head(data: bytes) -> tuple[str, int, int] | None:
    """(type, width, height) out of an image file's first bytes, or None if they are of no known kind."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("image/png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("image/gif", *struct.unpack("<HH", data[6:10]))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return ("image/webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return ("image/webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        width, height = struct.unpack("<HH", data[26:30])
        return ("image/webp", width & 0x3FFF, height & 0x3FFF)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("image/jpeg", width, height)
        at += 1 if marker == 0xFF else 2 if 0xD0 <= marker <= 0xD9 else 2 + max(size, 2)
    return None


def read_images(spark: SparkSession, path: str, largest: int, types: DataFrame | None = None, with_content: bool = True) -> DataFrame:
    """(path, modificationTime, length, format, width, height, content) of image files up to ``largest`` bytes.

    Images are known by their type or ending; format and size come from their first bytes, and are null
    where these are of no known kind.  Of larger files nothing is read but their listing.
    """
    files = _files(spark, path, types)
    image = F.coalesce(F.col("content_type").startswith("image/"), F.lit(False)) | ending_of(F.col("path")).isin(IMAGE_ENDINGS)
    kept = files.where(image & (F.col("length") <= largest))

    @F.pandas_udf("struct<format: string, width: int, height: int>")
    def head(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            found = [image_head(bytes(c)) or (None, None, None) for c in contents]
            yield pd.DataFrame(found, columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    sized = kept.withColumn("head", head("content"))
    return sized.select("path", "modificationTime", "length", "head.*", *(["content"] if with_content else []))
