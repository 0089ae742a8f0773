"""Language of every text, with spans of one language in texts of several.

A word's script (by code point ranges) narrows its candidate languages to those that use the
script in the learning sample; its character n-grams give a log likelihood under each candidate;
Viterbi over the words, with a penalty for each change of language, labels the words.  The text's
language is that of most of its letters.  A word is of one script: what stands between spaces or
line ends is cut where its letters change script, and between the letters of scripts without spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import ranges, text_slices, word_table
from palaver.llm.subwords import char_grams

SAMPLE_DOCS = 5000
BUCKETS = 1 << 17
#: Log likelihood lost by a change of language between two words.
SWITCH = 6.0
#: A script belongs to a language if it writes at least this share of the language's letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

# The first code point of a block of one script, as in the Unicode block list.
SCRIPT_STARTS = np.array([0x0000, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0B80, 0x0C00, 0x0E00, 0x0F00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C60, 0x2E80, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xA640, 0xA720, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x10000])
SCRIPT_NAMES = ["Latin", "Other", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Other", "Devanagari", "Bengali", "Indic", "Tamil", "Indic", "Thai", "Tibetan", "Georgian", "Hangul", "Ethiopic", "Latin", "Greek", "Other", "Latin", "Han", "Kana", "Kana", "Other", "Han", "Other", "Cyrillic", "Latin", "Hangul", "Other", "Han", "Other", "Other"]
SCRIPTS = sorted(set(SCRIPT_NAMES))
SCRIPT_OF_RANGE = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])


#: Scripts whose words aren't set apart: each letter is a word there, and runs of one language are found among them.
UNSPACED = {SCRIPTS.index(n) for n in ("Han", "Kana", "Thai")}
#: Numbers of a slice's words times languages that are held at once, about.
HELD = 12 << 20


def script_of(letter: str) -> int:
    return int(SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, ord(letter), side="right") - 1])


def one_script(token: str) -> list[str]:
    """The token's words: joined they are the token."""
    if not token or max(token) < "\u0250":  # all Latin
        return [token]
    cuts, last = [0], -1
    for i, c in enumerate(token):
        if c.isalpha():
            script = script_of(c)
            if last >= 0 and (script != last or script in UNSPACED):
                cuts.append(i)
            last = script
    return [token[a:b] for a, b in zip(cuts, [*cuts[1:], len(token)], strict=True)]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Words' codes in order, the number of words before each text, the distinct words, and where each word begins in its text."""
    codes, before, tokens = word_table(texts, " \n")
    parts = [one_script(t) for t in tokens]
    known: dict[str, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for p in parts for w in p], dtype=np.int64)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    words, count = list(known), sizes[codes]
    out = flat[ranges((np.cumsum(sizes) - sizes)[codes], count)]
    ends = np.cumsum(count)
    taken = np.fromiter(map(len, words), dtype=np.int64, count=len(words))[out]
    taken[ends - 1] += 1  # the separator after a token's last word
    new = np.concatenate([[0], ends])[before]
    begins = np.cumsum(taken) - taken
    first = np.append(begins, 0)[np.minimum(new[:-1], len(begins))]
    return out, new, words, begins - np.repeat(first, np.diff(new))


@dataclass
class LanguageModel:
    languages: list[str]
    likelihood: np.ndarray  # buckets x languages: log P(n-gram | language)
    uses: np.ndarray  # scripts x languages: whether the language is written so


def letters_and_script(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of letters of each word and the script of its first letter (-1 without one)."""
    letters, first = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
    for i, w in enumerate(words):
        own = w if w.isalpha() else [c for c in w if c.isalpha()]
        if own:
            letters[i], first[i] = len(own), ord(own[0])
    script = SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, np.maximum(first, 0), side="right") - 1]
    return letters, np.where(first < 0, -1, script)


def fit(sample: DataFrame, bound: int = SAMPLE_DOCS) -> LanguageModel:
    """Count the n-grams of a bounded (text, label) sample by language; label is the language."""
    rows = sample.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "text", "label").limit(2 * bound).select("text", "label").collect()
    languages = sorted({r["label"] for r in rows})
    grams, uses = np.full((BUCKETS, len(languages)), 0.1), np.zeros((len(SCRIPTS), len(languages)))
    for k, language in enumerate(languages):
        codes, _, words, _ = words_of(pa.array([r["text"] for r in rows if r["label"] == language], pa.string()))
        count, lower = np.bincount(codes, minlength=len(words)), [w.lower() for w in words]
        letters, script = letters_and_script(words)
        ids, owner = char_grams(lower, 1, 4)
        known = letters[owner] > 0
        grams[:, k] += np.bincount((ids[known] % np.uint64(BUCKETS)).astype(np.int64), weights=np.minimum(count, 1000)[owner[known]], minlength=BUCKETS)
        uses[:, k] = np.bincount(script[script >= 0], weights=(letters * count)[script >= 0], minlength=len(SCRIPTS))
    if languages:
        uses = uses / np.maximum(uses.sum(axis=0), 1) >= SCRIPT_SHARE
        grams = np.log(grams / grams.sum(axis=0))
        grams -= grams.mean(axis=1, keepdims=True)
    return LanguageModel(languages, grams.astype(np.float32), uses.astype(bool))


def word_scores(words: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Letters and scores (words x languages) of distinct words; wordless tokens score alike everywhere."""
    letters, script = letters_and_script(words)
    ids, owner = char_grams([w.lower() for w in words], 1, 4)
    ids = (ids % np.uint64(BUCKETS)).astype(np.int64)
    n = np.maximum(np.bincount(owner, minlength=len(words)), 1)
    scores = np.stack([np.bincount(owner, weights=model.likelihood[ids, k], minlength=len(words)) for k in range(len(model.languages))], axis=1)
    scores *= (np.minimum(n, 8) / n)[:, None]  # n-grams of a word overlap; a long word is not as many facts
    scores[letters == 0] = 0
    allowed = model.uses[np.maximum(script, 0)]
    narrowed = (script >= 0) & allowed.any(axis=1)
    return letters, np.where(narrowed[:, None] & ~allowed, scores.min(axis=1, keepdims=True) - 20, scores).astype(np.float32)


def viterbi(emissions: np.ndarray, before: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word; texts lie one after another and are stepped through side by side."""
    lengths = np.diff(before)
    order = np.argsort(-lengths, kind="stable")
    starts, longest = before[:-1][order], int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), side="right")  # texts that have a word at each step
    kind = np.uint8 if emissions.shape[1] <= 256 else np.int32
    came = np.zeros(emissions.shape, dtype=kind)
    own = np.arange(emissions.shape[1], dtype=kind)
    best = emissions[starts[: active[0]]].copy() if longest else emissions[:0]
    for step in range(1, longest):
        n = active[step]
        prev, at = best[:n], starts[:n] + step
        top = prev.argmax(axis=1)
        switched = prev[np.arange(n), top] - penalty
        stay = prev >= switched[:, None]
        came[at] = np.where(stay, own, top[:, None].astype(kind))
        best[:n] = np.where(stay, prev, switched[:, None]) + emissions[at]
    labels = np.zeros(len(emissions), dtype=kind)
    state = best.argmax(axis=1).astype(kind) if longest else np.zeros(0, kind)
    for step in range(longest - 1, -1, -1):
        n = active[step]
        at = starts[:n] + step
        labels[at] = state[:n]
        if step:
            state[:n] = came[at, state[:n]]
    return labels


def label_languages(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) for every row.

    ``lang_pred`` is ``und`` for a null text and one without a letter; else the language of most
    letters (ties: the first by name).  ``score`` is the share of the letters in it, times the mean
    confidence of its words.  ``spans``: (lang, first, last, start, end) of each run of one language,
    as word numbers and as code points, end exclusive.  Repeated rows get equal results; rows without
    an id are rows like others; texts of any length are read whole, one at a time where they are long;
    an empty table gives no rows; other columns are not read.  Without any learned language every
    text is ``und``.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(sample))  # 2^17 numbers a language
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    schema += ", spans array<struct<lang: string, first: bigint, last: bigint, start: bigint, end: bigint>>" * with_spans
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        k = len(known.languages)
        # a word is five bytes or so, and its scores are held three times over
        for rows in text_slices(batches, 1, min(3 << 20, 5 * HELD // max(k, 1))):
            codes, before, words, begins = words_of(rows.column(1))
            doc = np.repeat(np.arange(rows.num_rows), np.diff(before))
            if k:
                letters, scores = word_scores(words, known)
                emissions = scores[codes]
                labels = viterbi(emissions, before, SWITCH)
                total = np.zeros((rows.num_rows, k))
                np.add.at(total, (doc, labels), letters[codes])
                sure = np.exp(emissions - emissions.max(axis=1, keepdims=True))
                sure = sure[np.arange(len(codes)), labels] / sure.sum(axis=1)
                weight = np.bincount(doc, weights=sure * letters[codes], minlength=rows.num_rows)
            else:
                labels, total, weight = np.zeros(len(codes), np.uint8), np.zeros((rows.num_rows, 1)), np.zeros(rows.num_rows)
            all_letters = total.sum(axis=1)
            best = np.where(all_letters > 0, total.argmax(axis=1), k)
            share = total.max(axis=1) / np.maximum(all_letters, 1)
            score = np.where(all_letters > 0, share * weight / np.maximum(all_letters, 1), 0.0)
            out = [rows.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())]
            if with_spans:
                change = np.ones(len(codes) + 1, dtype=bool)
                change[1:-1] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(change)
                firsts, lasts = at[:-1], at[1:] - 1
                runs, ends = [[] for _ in range(rows.num_rows)], begins + np.fromiter(map(len, words), dtype=np.int64, count=len(words))[codes]
                for a, b in zip(firsts, lasts, strict=True):
                    if best[d := doc[a]] < k:
                        runs[d].append({"lang": names[labels[a]], "first": int(a - before[d]), "last": int(b - before[d]), "start": int(begins[a]), "end": int(ends[b])})
                out.append(pa.array(runs, span_type))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    return slim.mapInArrow(labelled, schema)
