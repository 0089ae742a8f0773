"""Secrets in texts, with the parts of one credential linked to each other.

Three patterns are secrets wherever they stand (``BASE``).  Access identifiers, secret values and
endpoints that say nothing alone are weak candidates: they are reported where their complement
stands within reach in the same scope, a paragraph.  The join of the parts' intervals is by binary
search over the sorted parts of a text; scopes never leave a text, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palaver.llm.common import text_slices, with_text

#: Kinds in the order in which spans of one start are listed; the first three are found by pattern alone.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]
#: Code points between two parts of one credential.
REACH = 300

# The patterns of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

NAMED_IDENTIFIER = re.compile(r"""(?<![a-z0-9])(?:access_?key(?:_?id)?|client_?id|account(?:_?(?:id|name))?|user(?:_?(?:id|name))?|login)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.@=-]{3,})""", re.I | re.A)
NAMED_SECRET = re.compile(r"""(?:access_?key|private_?key|signature|credential|pass|pwd|auth)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]{8,})""", re.I | re.A)
BARE_SECRET = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
ENDPOINT = re.compile(
    r"""\b(?:https?|s3|s?ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)://[^\s"'<>]+"""
    r"""|\b(?:host(?:name)?|endpoint|server|bucket)["']?\x20*[:=]\x20*["']?[a-z0-9._:/-]{3,}"""
    r"""|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])""",
    re.I | re.A,
)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


@dataclass
class Parts:
    """Spans of one role in a text, in order and apart from each other; ``weak``: reported only when linked."""

    start: np.ndarray
    end: np.ndarray
    scope: np.ndarray
    weak: np.ndarray

    def rank(self, scope: np.ndarray, at: np.ndarray, edge: str, side: str) -> np.ndarray:
        """How many parts lie in earlier scopes, or in this one with their start or end before ``at``."""
        size = 4 * REACH + 4 + int(max(self.end.max(initial=0), at.max(initial=0)))
        return np.searchsorted(self.scope * size + getattr(self, edge), scope * size + np.clip(at, -REACH, size - REACH - 1), side)

    def near(self, other: Parts) -> np.ndarray:
        """For each part, whether a part of ``other`` in its scope meets its interval, widened by the reach."""
        return self.rank_range(other, 1) > self.rank_range(other, 0)

    def rank_range(self, other: Parts, upper: int) -> np.ndarray:
        if upper:
            return other.rank(self.scope, self.end + REACH, "start", "right")
        return other.rank(self.scope, self.start - REACH, "end", "left")

    def nearest(self, other: Parts) -> np.ndarray:
        """For each part, the place in ``other`` of the nearest part in reach (the earlier of two), or -1."""
        low, high = self.rank_range(other, 0), self.rank_range(other, 1)
        after = np.clip(other.rank(self.scope, self.start, "start", "left"), low, high)
        best, gap = np.full(len(low), -1), np.full(len(low), np.iinfo(np.int64).max)
        for at in (after - 1, after):
            held = (at >= low) & (at < high)
            i = np.where(held, at, 0)
            if len(other.start):
                apart = np.where(held, np.maximum(np.maximum(other.start[i] - self.end, self.start - other.end[i]), 0), np.iinfo(np.int64).max)
                best, gap = np.where(held & (apart < gap), at, best), np.minimum(gap, apart)
        return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one (a hex value that is assigned is one part)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _clear(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order that meet none of those taken."""
    held = _merged(taken)
    ends = [b for _, b in held]
    return [(a, b) for a, b in sorted(spans) if (i := bisect_right(ends, a)) == len(held) or held[i][0] >= b]


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order that meet neither those taken nor an earlier one."""
    out, last = [], -1
    for a, b in _clear(spans, taken):
        if a >= last:
            out.append((a, b))
            last = b
    return out


def _parts(strong: list[tuple[int, int]], weak: list[tuple[int, int]], breaks: np.ndarray) -> Parts:
    rows = sorted([(a, b, 0) for a, b in _merged(strong)] + [(a, b, 1) for a, b in weak])
    start, end, is_weak = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    return Parts(start, end, np.searchsorted(breaks, start, side="right"), is_weak.astype(bool))


def linked(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Weak spans with a complement (start, end, kind), and credentials: spans of an identifier, a secret, an endpoint.

    An identifier and a secret within reach complement each other; an endpoint needs both.  A weak
    candidate that meets a base span isn't one.  A credential is an identifier with its nearest
    secret and, if there is one in reach, its nearest endpoint.
    """
    assigned = ":" in text or "=" in text
    taken = [(a, b) for a, b, _ in base]
    strong_ids = [(a, b) for a, b, k in base if k == 1]
    strong_secrets = _clear([(a, b) for a, b, k in base if k != 1], strong_ids)
    names = _apart([m.span() for m in NAMED_IDENTIFIER.finditer(text)], taken) if assigned else []
    if not names and not strong_ids:
        return [], []
    values = [m.span() for m in BARE_SECRET.finditer(text) if _mixed(m.group())]
    if assigned:
        values = [m.span() for m in NAMED_SECRET.finditer(text)] + values
    values = _apart(values, taken + names)
    if not values and not strong_secrets:
        return [], []
    breaks = np.array([m.end() for m in BLANK_LINE.finditer(text)], dtype=np.int64)
    ids, secrets = _parts(strong_ids, names, breaks), _parts(strong_secrets, values, breaks)
    ends = _parts([], _apart([m.span() for m in ENDPOINT.finditer(text)], taken + names + values), breaks)
    paired, used = ids.near(secrets), secrets.near(ids)
    both = ends.near(ids) & ends.near(secrets)
    spans = [(int(p.start[i]), int(p.end[i]), k) for p, keep, k in ((ids, paired & ids.weak, 3), (secrets, used & secrets.weak, 4), (ends, both, 5)) for i in np.flatnonzero(keep)]
    mate, place = ids.nearest(secrets), ids.nearest(ends)
    credentials = [
        (_span(ids, i), _span(secrets, mate[i]), _span(ends, place[i]) if place[i] >= 0 and both[place[i]] else None)
        for i in np.flatnonzero(paired)
    ]
    return spans, credentials


def _mixed(value: str) -> bool:
    """Upper and lower case and digits, as random keys have and words have not."""
    return any(map(str.isdigit, value)) and any(map(str.isupper, value)) and any(map(str.islower, value))


def _span(parts: Parts, i: int) -> dict:
    return {"start": int(parts.start[i]), "end": int(parts.end[i])}


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
CREDENTIALS = pa.list_(pa.struct([("identifier", SPAN), ("secret", SPAN), ("endpoint", SPAN)]))
SCHEMA = "spans array<struct<kind: string, start: long, end: long>>, credentials array<struct<identifier: struct<start: long, end: long>, secret: struct<start: long, end: long>, endpoint: struct<start: long, end: long>>>"


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every run of spans replaced by the kind of its first one, in brackets."""
    out, last = [], 0
    for a, b, kind in spans:
        if a >= last:
            out += [text[last:a], f"[{KINDS[kind]}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find_credentials(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """Each row as struct ``doc`` with its spans, its credentials and, if asked for, its redacted text.

    Spans are in code points, end exclusive, by start and kind.  A null or empty text has none;
    texts of any length are read whole, in time linear in their length; repeated rows are read
    each; rows without an id and columns of any name are kept in ``doc``; an empty table gives no
    rows.  Spans that start together are listed in the order of ``KINDS``.
    """
    names = ["doc", "spans", "credentials"] + ["redacted"] * redact

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(with_text(batches, text), 1):
            spans, credentials, clean = [], [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                more, linked_parts = linked(t, base) if t else ([], [])
                every = sorted(base + more, key=lambda s: (s[0], s[2]))
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in every])
                credentials.append([dict(zip(("identifier", "secret", "endpoint"), c, strict=True)) for c in linked_parts])
                clean.append(redacted(t, every) if redact and t else t)
            columns = [batch.column(0), pa.array(spans, SPANS), pa.array(credentials, CREDENTIALS)] + [pa.array(clean, pa.string())] * redact
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    more = StructType.fromDDL(SCHEMA + ", redacted string" * redact)
    return rows.mapInArrow(found, StructType([*rows.schema.fields, *more.fields]))
