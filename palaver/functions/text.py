"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.terms import first_group


def normalised(text: Column) -> Column:
    """Runs of white space (of any script) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _folded_letters() -> tuple[str, str]:
    """Letters that are another letter with marks, and those letters; the marks themselves have none."""
    marked = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0xD800)}
    base = {c: d[0] for c, d in marked.items() if len(d) > 1 and d[0].isalpha() and all(map(unicodedata.combining, d[1:])) and c == c.lower()}
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(base) + marks, "".join(base.values())


MARKED, PLAIN = _folded_letters()


def folded(text: Column) -> Column:
    """Lower case without diacritics, in any script."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, MARKED, PLAIN)).otherwise(low)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def query_tokens(query: Column, most: int | None = 24, least: int = 2) -> Column:
    """Distinct tokens of ``least`` characters or more, letter case aside; the first spelling stays.

    ``most``: how many tokens, repeats included, are looked at; all where it is None.
    """
    tokens = F.regexp_extract_all(query, F.lit(rf"[A-Za-z0-9_@#./:\-]{{{least},}}"), F.lit(0))
    tokens = tokens if most is None else F.slice(tokens, 1, most)
    spellings = F.sort_array(F.transform(tokens, lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("at"), t.alias("token"))))
    first = _once(spellings, lambda s: F.filter(s, lambda x, i: ~F.get(s, i - 1)["low"].eqNullSafe(x["low"])))
    placed = F.sort_array(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"))))
    return F.transform(placed, lambda x: x["token"])


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


# Patterns that ask for a web search.
URL_PATTERN = r"(https?://|www\.)"
EXPLICIT_SEARCH = [r"\bsearch\b", r"\bweb search\b", r"\binternet search\b", r"\blook ?up\b", r"\bcheck online\b", r"\bfind online\b", r"\bgoogle\b", r"\bsearch for\b"]
LIVE_DATA = [r"\bnews\b", r"\bweather\b", r"\bforecast\b", r"\bstock price\b", r"\bcrypto price\b", r"\bscores?\b", r"\bstandings\b"]
RECENT_WORDS = r"\b(latest|newest|most recent|breaking|today(?:'s)?|recent)\b"
RECENT_TOPICS = r"\b(news|updates?|events?|prices?|scores?)\b"


def wants_search(prompt: Column) -> Column:
    text = normalised(F.lower(prompt))
    hit = any_match(text, [URL_PATTERN, *EXPLICIT_SEARCH, *LIVE_DATA]) | (text.rlike(RECENT_WORDS) & text.rlike(RECENT_TOPICS))
    return F.coalesce(hit, F.lit(False))


# Substrings of error messages by category; the first category that matches counts.
ERROR_TERMS = [
    ("image_size_error", ["image size", "file too large", "exceeds maximum size"]),
    ("image_format_error", ["unsupported format", "invalid format", "image format"]),
    ("nano_banana_api_error", ["nano-banana", "nano_banana", "image editing service"]),
    ("image_validation_error", ["image validation", "corrupted image", "invalid image"]),
    ("image_upload_error", ["image upload", "upload failed"]),
    ("image_download_error", ["image download", "download failed"]),
    ("image_processing_error", ["image processing", "image edit"]),
    ("message_split_error", ["message split", "splitting failed"]),
    ("markdown_processing_error", ["markdown processing", "markdown error"]),
    ("message_too_long_error", ["message too long", "exceeds character limit"]),
    ("rate_limit", ["rate limit", "quota exceeded", "too many requests"]),
    ("timeout", ["timeout", "timed out"]),
    ("authentication_error", ["authentication", "unauthorized", "api key", "invalid key"]),
    ("service_unavailable", ["service unavailable", "server error", "503", "502", "500"]),
    ("empty_response", ["empty response", "no content", "blank response"]),
    ("invalid_request", ["invalid request", "bad request", "400", "malformed"]),
    ("configuration_error", ["configuration", "config", "missing token", "token not found"]),
    ("validation_error", ["validation", "invalid format", "format error"]),
    ("context_collection_error", ["context", "history", "message retrieval"]),
]
RETRYABLE = ["rate_limit", "timeout", "service_unavailable", "discord_http_error", "discord_connection_error", "nano_banana_api_error", "image_upload_error", "image_download_error", "message_split_error"]
WARNINGS = ["rate_limit", "timeout", "empty_response"]
# Classes of exceptions that decide before any term does, and those that come from them.
ERROR_CLASSES = {"Forbidden": "discord_permission_error", "HTTPException": "discord_http_error", "ConnectionClosed": "discord_connection_error"}
ERROR_BASES = {"NotFound": "HTTPException", "DiscordServerError": "HTTPException"}


def error_category(message: Column, error_class: Column | None = None, bases: Column | None = None) -> Column:
    """The category by class, else by the first group of terms that the message has; null messages are unknown.

    ``error_class``: the exception's class; ``bases``: the classes that it comes from, as an array,
    where they are known (those of ERROR_BASES are).
    """
    case = F.when(F.lit(False), F.lit(""))
    if error_class is not None:
        known = F.create_map(*[F.lit(x) for pair in ERROR_BASES.items() for x in pair])
        names = F.array_compact(F.array(error_class, F.try_element_at(known, error_class)))
        names = names if bases is None else F.concat(names, F.coalesce(bases, F.array().cast("array<string>")))
        for name, kind in ERROR_CLASSES.items():
            case = case.when(F.array_contains(names, name), F.lit(kind))
    by_term = F.get(F.array(*[F.lit(kind) for kind, _ in ERROR_TERMS]), first_group(message, [terms for _, terms in ERROR_TERMS]))
    return case.otherwise(F.coalesce(by_term, F.lit("unknown_error")))


def is_retryable(category: Column) -> Column:
    return category.isin(RETRYABLE)


def log_level(category: Column) -> Column:
    return F.when(category.isin(WARNINGS), "WARNING").otherwise("ERROR")


# Patterns of edit instructions by kind, in the order that decides ties.
EDIT_PATTERNS = {
    "object_removal": [r"\b(remove|delete|erase|eliminate|take\s+out)\b.*\b(object|person|thing|item)\b", r"\b(get\s+rid\s+of|clear\s+away)\b", r"\bremove\s+the\s+\w+", r"\bdelete\s+\w+"],
    "background_replacement": [r"\b(change|replace|swap|switch)\s+(the\s+)?background\b", r"\bbackground\s+(to|with|as)\b", r"\bput\s+.*\s+(in|on|at|to)\b", r"\bplace\s+.*\s+(in|on|at|to)\b", r"\bmake\s+the\s+background\b", r"\bon\s+top\s+of\b", r"\bin\s+front\s+of\b", r"\b(move|relocate|position)\s+\w+\s+to\b"],
    "style_transfer": [r"\b(style|artistic|art)\s+(of|like|as)\b", r"\bmake\s+it\s+(look\s+like|in\s+the\s+style\s+of)\b", r"\b(convert|transform)\s+to\s+\w+\s+style\b", r"\bapply\s+.*\s+style\b"],
    "color_adjustment": [r"\b(adjust|change|modify)\s+(color|brightness|contrast|saturation)\b", r"\bmake\s+it\s+(brighter|darker|more\s+colorful|less\s+colorful)\b", r"\b(increase|decrease|enhance)\s+(brightness|contrast|saturation)\b", r"\bcolor\s+(correction|grading)\b"],
}
# Word boundaries, white space and any character as the queries' SQL has them: of ASCII, and all but the end of a line.
# A boundary stands before a word, where a letter or group follows, or else after one.
SQL_CLASSES = [(r"\\b(?=[a-z(])", r"(?<!\w)"), (r"\\b", r"(?!\w)"), (r"\\s", r"[\t\n\f\r ]"), (r"\.\*", r"[^\n]*")]
FILLERS = ["please", "can you", "could you", "i want", "i need", "help me"]


def edit_kind(instruction: Column) -> Column:
    """struct(kind, confidence): the kind with most pattern matches, the first one of equals."""
    low = F.trim(F.lower(F.replace(instruction, F.lit("\u0130"), F.lit("i"))))  # the one capital whose small form is two characters
    plain = lambda p: reduce(lambda out, c: re.sub(c[0], lambda m: c[1], out), SQL_CLASSES, p)
    counts = [reduce(lambda a, b: a + b, [F.size(F.regexp_extract_all(low, F.lit(plain(p)), F.lit(0))) for p in ps]) for ps in EDIT_PATTERNS.values()]
    most = F.greatest(*counts)
    kind = F.when(most == 0, "general_edit")
    for name, count in zip(EDIT_PATTERNS, counts, strict=True):
        kind = kind.when(count == most, name)
    return F.struct(kind.alias("kind"), F.when(most == 0, 0.5).otherwise(F.least(most / 3.0, F.lit(1.0))).alias("confidence"))


def clean_instruction(instruction: Column) -> Column:
    text = normalised(instruction)
    for filler in FILLERS:
        text = F.regexp_replace(text, rf"(?i)\b{filler}\b", "")
    text = normalised(text)
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def without_mentions(text: Column, collapse: bool = True) -> Column:
    plain = F.trim(F.regexp_replace(text, r"<@!?\d+>|@everyone|@here", ""))
    return normalised(plain) if collapse else plain


def router_key(text: Column) -> Column:
    return F.left(normalised(F.lower(text)), F.lit(200))


def status_label(status: Column) -> Column:
    return F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))


def safe_filename(text: Column) -> Column:
    kept = F.trim(F.left(F.regexp_replace(text, r"[^\p{L}\p{N} _\-]", ""), F.lit(30)))
    return F.replace(kept, F.lit(" "), F.lit("_"))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    units = [("d", F.floor(s / 86400)), ("h", F.floor(s % 86400 / 3600)), ("m", F.floor(s % 3600 / 60)), ("s", s % 60)]
    parts = [F.when((n > 0) | ((s <= 0) & F.lit(u == "s")), F.concat(n.cast("bigint").cast("string"), F.lit(u))) for u, n in units]
    return F.concat_ws(" ", *parts)


def chat_line(at: Column, author: Column, text: Column, is_reply: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(at, "HH:mm"), F.lit("] "), author, F.when(is_reply, " (replying)").otherwise(""), F.lit(": "), text)


def prompt_line(label: Column, author: Column, text: Column, source: Column, score: Column, reason: Column) -> Column:
    details = F.concat_ws(", ", F.concat(F.lit("source="), source), F.concat(F.lit("score="), F.format_string("%.3f", score)), F.concat(F.lit("reason="), reason))
    return F.concat(label, F.lit(" ["), details, F.lit("] "), author, F.lit(": "), text)


def attachment_summary(attachments: Column) -> Column:
    """``name (type), ...`` of array<struct<filename, content_type>>."""
    one = lambda a: F.concat(F.coalesce(a["filename"], F.lit("attachment")), F.lit(" ("), F.coalesce(a["content_type"], F.lit("unknown")), F.lit(")"))
    return F.array_join(F.transform(attachments, one), ", ")


def message_content(text: Column, system_text: Column, kind: Column, attachments: Column, embeds: Column, stickers: Column, snapshots: Column) -> Column:
    """The text with a bracketed note of what else the message holds.

    attachments: array<struct<filename, content_type>>; embeds: int; stickers: array<string>
    (null names allowed); snapshots: array<struct<content, kind, attachments int, embeds int, stickers int>>.
    """
    base = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.trim(F.coalesce(system_text, F.lit(""))))
    is_image = lambda a: F.coalesce(a["content_type"].startswith("image/"), F.lit(False))
    names = lambda keep: F.array_join(F.transform(F.filter(attachments, keep), lambda a: a["filename"]), ", ")
    images, files = names(is_image), names(lambda a: ~is_image(a))
    known = F.array_join(F.filter(stickers, lambda s: s.isNotNull() & (s != "")), ", ")

    def forwarded(s: Column, i: Column) -> Column:
        number = F.concat(F.lit("Forwarded["), (i + 1).cast("string"), F.lit("]"))
        own = F.trim(F.coalesce(s["content"], F.lit("")))
        rest = F.format_string(" type=%s, attachments=%d, embeds=%d, stickers=%d", F.coalesce(s["kind"], F.lit("unknown")), *[F.coalesce(s[c], F.lit(0)) for c in ("attachments", "embeds", "stickers")])
        return F.when(own != "", F.concat(number, F.lit(": "), truncated(own, 180))).otherwise(F.concat(number, rest))

    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("Message type: "), kind),
        F.when(images != "", F.concat(F.lit("Attached images: "), images)),
        F.when(files != "", F.concat(F.lit("Attached files: "), files)),
        F.when(embeds > 0, F.concat(F.lit("Embeds: "), embeds.cast("string"))),
        F.when(known != "", F.concat(F.lit("Stickers: "), known)).when(F.size(stickers) > 0, F.concat(F.lit("Stickers: "), F.size(stickers).cast("string"))),
        F.transform(snapshots, forwarded),
    )
    return F.trim(F.concat(base, F.lit(" ["), parts, F.lit("]")))


# Names under which token counts come.
INPUT_NAMES = ["prompt_token_count", "prompt_tokens", "input_tokens", "promptTokenCount"]
OUTPUT_NAMES = ["candidates_token_count", "output_tokens", "candidatesTokenCount"]
TOTAL_NAMES = ["total_token_count", "total_tokens", "totalTokenCount"]


def token_usage(json: Column, inputs: list[str] = INPUT_NAMES, outputs: list[str] = OUTPUT_NAMES, totals: list[str] = TOTAL_NAMES) -> Column:
    """struct(input_tokens, output_tokens, total_tokens), null where no count is given or they contradict."""
    field = lambda names: F.coalesce(*[F.get_json_object(json, f"$.{n}").try_cast("bigint") for n in names])
    given, made, total = field(inputs), field(outputs), field(totals)
    some, i, o = given.isNotNull() | made.isNotNull() | total.isNotNull(), F.coalesce(given, F.lit(0)), F.coalesce(made, F.lit(0))
    t = F.coalesce(F.nullif(total, F.lit(0)), i + o)
    valid = some & (i >= 0) & (o >= 0) & (t >= i + o)
    return F.when(valid, F.struct(i.cast("bigint").alias("input_tokens"), o.cast("bigint").alias("output_tokens"), t.cast("bigint").alias("total_tokens")))


def hard_split(text: Column, most: int) -> Column:
    """Pieces of ``most`` characters, the last one shorter; one empty piece for an empty text."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(most)) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * most + 1, F.lit(most)))


def backoff_seconds(attempt: Column, jitter: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt) + jitter, F.lit(30.0))


def embedding_retry_seconds(attempts: Column) -> Column:
    return F.least(60 * F.pow(F.lit(2.0), attempts - 1), F.lit(3600.0))


# Seconds for each megapixel by kind of edit.
EDIT_SECONDS = {"object_removal": 3.0, "background_replacement": 4.0, "style_transfer": 5.0, "color_adjustment": 1.5, "general_edit": 3.0}


def edit_seconds(kind: Column, width: Column, height: Column) -> Column:
    megapixels = width * height / 1_000_000
    base = F.coalesce(F.create_map(*[x for k, v in EDIT_SECONDS.items() for x in (F.lit(k), F.lit(v))])[kind], F.lit(3.0)) * megapixels
    scaled = base * F.when(megapixels > 10, 1.5).when(megapixels > 5, 1.2).otherwise(1.0)
    return F.round(F.least(F.greatest(scaled, F.lit(5.0)), F.lit(120.0)), 1)


def vector_of(json: Column) -> Column:
    """A JSON array of numbers as doubles; null where it is malformed or holds anything else."""
    vector = F.from_json(json, "array<double>")
    return F.when(F.forall(vector, lambda x: x.isNotNull()), vector)


def ids_json(ids: Column) -> Column:
    """An array of ids as JSON; null counts as empty."""
    return F.to_json(F.coalesce(ids, F.array().cast("array<bigint>")))
