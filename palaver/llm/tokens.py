"""Whole texts to ids of a public tokenizer, a batch at a time, and crc32 over ids."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palaver.llm.common import held, text_slices

#: White space that the tokenizer's pattern joins into runs; a text is cut into words only where
#: each run that has a space or a line end is that one character.
SPACE = r"\t-\r\x1c-\x1f \x{85}\pZ"
RUNS = rf"(?:[ \n][{SPACE}])|(?:[{SPACE}][ \n])|\x1f"
#: Words that stay the same words between line ends: white space is at most one space, before them.
INNER = rf"^ ?[^{SPACE}](?:(?s:.*)[^{SPACE}])?$"

#: Bytes of words in a generation of the cache; a Python worker keeps two generations.
CACHE_BYTES = 4 << 20
#: Words that are encoded as one text, a line each.
LINES = 200


class Words:
    """Words and their ids, side by side."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words, self.ids = words, ids

    def plus(self, other: Words) -> Words:
        return Words(pa.concat_arrays([self.words, other.words]), pa.concat_arrays([self.ids, other.ids]))

    def take(self, at: pa.Array) -> Words:
        return Words(self.words.take(at), self.ids.take(at))


def id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of ids that end before ``ends``."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), pa.array(ids, pa.uint32()))


class Encoder:
    """Encodes texts as the tokenizers library does, each distinct word once.

    The byte-level pattern never joins characters across a single space (which begins a token) or
    a single line end (a token of its own), so the ids of a text are those of its words in order,
    and many words are encoded at once as lines of one text.  Texts with longer runs of white space
    or with an added token of the tokenizer (such as its end-of-text mark) are encoded whole, as
    are all texts where the file has another kind of pattern.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        cut = parts["pre_tokenizer"] or {}
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_words = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not parts["normalizer"] and len(self.line_end) == 1
        added = ["".join(f"\\x{{{ord(c):x}}}" for c in t["content"]) for t in parts["added_tokens"]]
        self.whole = "|".join([RUNS, *added])
        nothing = Words(pa.array([], pa.large_string()), id_lists(np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        self.fixed = Words(pa.array(["", "\n"], pa.large_string()), id_lists(np.array(self.line_end[:1], np.uint32), np.array([0, 1])))
        self.younger, self.older, self.nothing = nothing, nothing, nothing

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_whole(self, texts: pa.Array) -> Words:
        ids = self.ids_of(texts.to_pylist())
        return Words(texts, id_lists(np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum([len(x) for x in ids], dtype=np.int64)))

    def encoded_lines(self, words: pa.Array) -> Words:
        """Words as lines of one text for each LINES of them: the ids between two line ends are a word's."""
        if not len(words):
            return self.nothing
        cuts = np.append(np.arange(0, len(words), LINES), len(words))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar("\n", pa.large_string()))
        ids = np.concatenate([np.append(x, np.uint32(self.line_end[0])) for x in self.ids_of(lines.to_pylist())])
        ends = np.flatnonzero(ids == self.line_end[0])
        if len(ends) != len(words):  # a word that the pattern cuts otherwise; none is known
            return self.encoded_whole(words)
        return Words(words, id_lists(np.delete(ids, ends), ends - np.arange(len(ends))))

    def look_up(self, words: pa.Array) -> pa.Array:
        """The words' ids; words in use move to the younger generation, the rest goes with the older."""
        if self.younger.words.nbytes > CACHE_BYTES:
            self.younger, self.older = self.nothing, self.younger
        known = self.fixed.plus(self.younger).plus(self.older)
        at = pc.index_in(words, value_set=known.words)
        new = words.filter(pc.is_null(at))
        inner = pc.match_substring_regex(new, INNER)
        fresh = self.encoded_lines(new.filter(inner)).plus(self.encoded_whole(new.filter(pc.invert(inner))))
        kept = len(self.fixed.words) + len(self.younger.words)
        used = known.take(at.filter(pc.fill_null(pc.greater_equal(at, kept), False)))
        self.younger = self.younger.plus(used).plus(fresh)
        every = known.plus(fresh)
        place = at.to_numpy(zero_copy_only=False) if not at.null_count else None
        if place is None:
            order = pc.index_in(new, value_set=fresh.words).to_numpy(zero_copy_only=False)
            place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            place[pc.is_null(at).to_numpy(zero_copy_only=False)] = order + len(known.words)
        return every.ids.take(pa.array(place.astype(np.int64)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and for each text the number of ids before it, with the total last."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), dtype=bool)
        marked = pc.if_else(pa.array(whole), "", texts)
        marked = pc.replace_substring(pc.replace_substring(marked, " ", "\x1f "), "\n", "\x1f\n\x1f")
        split = pc.split_pattern(marked, "\x1f")
        offsets = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        found = self.look_up(words.dictionary).take(words.indices)
        ids = found.flatten().to_numpy()
        before = (found.offsets.to_numpy() - found.offsets[0].as_py())[offsets - offsets[0]]
        if not whole.any():
            return ids, before
        rows = np.flatnonzero(whole)
        own = self.ids_of(texts.take(pa.array(rows)).to_pylist())
        sizes = np.diff(before)
        sizes[rows] = [len(x) for x in own]
        after = np.concatenate([[0], np.cumsum(sizes)])
        # texts by words have their ids in order; the others are put between
        out, mine = np.empty(after[-1], dtype=np.uint32), np.ones(after[-1], dtype=bool)
        for row, x in zip(rows, own, strict=True):
            out[after[row] : after[row + 1]] = x
            mine[after[row] : after[row + 1]] = False
        out[mine] = ids
        return out, after


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; it stays with the Python worker between tasks."""
    return held(("encoder", path), lambda: Encoder(path))


def encoded_slices(batches, text: int, path: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their ids (with the end id after each text) and id offsets."""
    tool = encoder(path)
    for part in text_slices(batches, text):
        ids, before = tool.encode(part.column(text))
        if end_id is not None:
            ids = np.insert(ids, before[1:], np.uint32(end_id))
            before = before + np.arange(len(before))
        yield part, ids.astype("<u4", copy=False), before


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
