"""Toxicity: a lexicon trie met by Levenshtein automata, with context windows around the matches.

The lexicon is learned from a bounded sample of labelled documents: a stem enters it if it begins
words of many toxic and hardly any clean documents, so that inflected forms never seen are met as
well.  Every distinct word of a text is a Levenshtein automaton (bit-parallel, one edit or one swap
of neighbours) that walks the trie of stems and of full terms; misspelled terms reach an accepting
node.  A word that several clean texts of the sample use is no misspelling.  Around each match a
window of words decides whether it stands in quotation or is said; a logistic layer, fitted on the
same sample, weighs said, misspelled and quoted matches into a score.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import checkpoint, held, text_slices, with_text, word_table
from palaver.llm.simhash import shingle_hashes
from palaver.llm.subwords import MIX

#: Labelled documents that the lexicon is learned from, and those that the logistic layer is fitted on.
SAMPLE_DOCS, LAYER_DOCS = 8000, 3000
#: A stem has so many characters at least; one edit is allowed from FUZZY characters on.
SHORTEST, FUZZY = 3, 5
#: Least shingle hashes by which near copies among the toxic texts are known.
SIGNATURE = 16
#: Clean texts that make a word near an entry a word of its own.
USUAL = 3
#: Toxic documents that a stem needs, however large the sample, and the clean ones allowed for each.
SUPPORT, CLEAN_PER_TOXIC = 5, 0.03
WINDOW = 4
#: Words in a generation of the verdicts that a Python worker keeps.
CACHE_WORDS = 100_000
#: Characters of an entry's beginning by which words that may be near it are found, and bits of that filter.
HEAD, FILTER_BITS = 8, 22
SHIFT = np.uint64(64 - FILTER_BITS)
#: Bytes of text that are scored at once.
SLICE_BYTES = 3 << 20

# Quotation marks, and digits or signs written for letters.
QUOTES = "\"'`«»“”„‘’‚‹›"
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

#: Runs of letters, digits, marks and signs that may stand for letters.
RUN = regex.compile(r"[\p{L}\p{N}@$!][\p{L}\p{N}\p{M}@$!]*")
#: Up to here every beginning of a word is counted; beyond, beginnings that are an eighth longer each time.
DENSE = 64
#: Letters of scripts that put no space between words: there a match may begin anywhere.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")

SAID, MISSPELLED, QUOTED = range(3)
#: The layer before any fit: bias, and the weight of log(1 + matches) of each kind.
PRIOR = np.array([-3.0, 4.0, 2.0, 1.0])


def parts_of(token: str) -> list[str]:
    """The words of a token in lower case: it may hold several, between signs or other white space.

    A word is a run less the signs at its end.
    """
    token = token.lower()
    return [token] if token.isalpha() else [w for run in RUN.findall(token) if (w := run.rstrip("@$!"))]


def lengths_up_to(n: int) -> Iterator[int]:
    """The lengths of the beginnings that are counted of a word of n characters: together linear in n."""
    k = SHORTEST
    while k <= n:
        yield k
        k += 1 if k < DENSE else k // 8


class Keys:
    """Filter keys of beginnings of words; equal strings have equal keys, a shorter word counts as padded."""

    def __init__(self, words: list[str]):
        width = HEAD + 1
        chars = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).T.astype(np.uint64)
        powers = np.cumprod(np.full(width + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))[:, None]
        none = np.zeros((1, len(words)), dtype=np.uint64)
        # sums of the characters' parts in their own places, and one place before
        self.here = np.concatenate([none, np.cumsum(chars * powers[1:], axis=0)])
        self.earlier = np.concatenate([none, np.cumsum(chars * powers[:-1], axis=0)])

    def whole(self, length: int) -> np.ndarray:
        """Of the first ``length`` characters."""
        return self.here[length] * MIX >> SHIFT

    def without(self, i: int, length: int) -> np.ndarray:
        """Of the first ``length`` characters less character i."""
        return (self.here[i] + self.earlier[length] - self.earlier[i + 1]) * MIX >> SHIFT


class Trie:
    """Stems (any continuation accepted) and full terms of the lexicon."""

    def __init__(self, stems: list[str], terms: list[str], usual: frozenset[str] = frozenset()):
        # nodes are numbers, so that a trie of any depth can be sent; how long a stem or term ends at a node, or 0
        self.next: list[dict[str, int]] = [{}]
        self.stem, self.term = [0], [0]
        self.deepest = max(map(len, [*stems, *terms]), default=0)
        self.usual = usual
        self.digest = hashlib.sha256(repr((sorted(stems), sorted(terms), sorted(usual))).encode()).hexdigest()
        # the beginnings of entries that one edit can reach, and what is left of them without one character
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        heads = sorted({e[:HEAD] for e in [*stems, *terms] if len(e) >= FUZZY})
        self.lengths = sorted({len(h) for h in heads})
        for length in self.lengths:
            keys = Keys([h for h in heads if len(h) == length])
            for at in (keys.whole(length), *[keys.without(i, length) for i in range(length)]):
                self.filter[at] = True
        for ends, entries in ((self.stem, stems), (self.term, terms)):
            for entry in entries:
                node = 0
                for c in entry:
                    child = self.next[node].setdefault(c, len(self.next))
                    if child == len(self.next):
                        self.next.append({})
                        self.stem.append(0)
                        self.term.append(0)
                    node = child
                ends[node] = len(entry)

    def exact(self, word: str, at: int = 0) -> bool:
        """Whether what stands in the word from ``at`` on is a term or begins with a stem."""
        node = 0
        for i in range(at, len(word)):
            child = self.next[node].get(word[i])
            if child is None:
                return False
            if self.stem[child]:
                return True
            node = child
        return self.term[node] > 0

    def may_be_near(self, words: list[str]) -> np.ndarray:
        """For each word whether its beginning may be one edit at most from an entry's; no near word is missed."""
        near = np.zeros(len(words), dtype=bool)
        keys = Keys(words)
        # a head missing a character begins a word as it is; else one of as many or one more characters is left out
        for length in {n - 1 for n in self.lengths}:
            near |= self.filter[keys.whole(length)]
        for length in {n + more for n in self.lengths for more in (0, 1)}:
            for i in range(length):
                near |= self.filter[keys.without(i, length)]
        return near

    def within_one(self, word: str) -> bool:
        """Whether the word's automaton (one edit or swap) accepts a term, or a stem that begins the word.

        Bit i of a state: the word's first i characters are read; states for no edit, for one edit,
        and for a swap of which the first character is read.
        """
        # two characters more than any entry: what follows can't change the answer
        word = word[: self.deepest + 2]
        n = len(word)
        if n < 3:
            return False
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        every, final = (1 << (n + 1)) - 1, 1 << n
        walk = [(0, 1, 0b11 & every, 0)]
        while walk:
            node, none, one, swap = walk.pop()
            if (none | one) & final and self.term[node] >= FUZZY or self.stem[node] > FUZZY:
                return True
            for c, child in self.next[node].items():
                mask = masks.get(c, 0)
                now = (none & mask) << 1
                # the same character read; then substituted, missing from the word, or one too many in it
                edited = ((one & mask) << 1 | none << 1 | none | now << 1 | (swap & mask) << 2) & every
                if now or edited:
                    walk.append((child, now, edited, none & mask >> 1))
        return False

    def begins_within(self, word: str) -> bool:
        """Whether an entry begins anywhere in a word of a script without spaces."""
        return any(self.exact(word, i) for i in range(len(word) - 1))

    def words_verdicts(self, words: list[str]) -> list[int]:
        """For each word 0 for no match, 1 exact, 2 misspelled."""
        bares = [w.lstrip("@$!") for w in words]
        plains = [w if w.isalpha() else w.translate(LEET) for w in words]
        out = []
        for word, bare, plain, near in zip(words, bares, plains, self.may_be_near(plains).tolist(), strict=True):
            if len(word) < SHORTEST:
                out.append(0)
            elif self.exact(bare):
                out.append(1)
            elif plain != word and self.exact(plain):
                out.append(2)
            elif UNSPACED.search(word):
                out.append(int(self.begins_within(word)))
            else:
                out.append(2 if near and len(plain) >= FUZZY - 1 and plain not in self.usual and self.within_one(plain) else 0)
        return out

    def verdicts(self, tokens: list[str]) -> list[int]:
        """For each token 0 for no match, 1 if a word of it is an exact one, 2 if one is misspelled."""
        parts = [parts_of(t) for t in tokens]
        words = list({w for p in parts for w in p})
        known = dict(zip(words, self.words_verdicts(words), strict=True))
        return [min((v for w in p if (v := known[w])), default=0) for p in parts]

    def verdict(self, token: str) -> int:
        return self.verdicts([token])[0]


def term_counts(texts: DataFrame, wanted: set[tuple[str, bool]] | None = None) -> DataFrame:
    """(term, whole, n): texts that have the word, or a word that begins so; of ``wanted`` terms alone, if given."""
    shipped = texts.sparkSession.sparkContext.broadcast(wanted)  # terms of a bounded sample

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, counts = shipped.value, {}
        for rows in text_slices(batches, 0):
            codes, before, tokens = word_table(rows.column(0), " \n")
            words = [parts_of(t) for t in tokens]
            for d in range(rows.num_rows):
                own = {w for c in np.unique(codes[before[d] : before[d + 1]]) for w in words[c] if len(w) >= SHORTEST}
                terms = {(w, True) for w in own}
                terms.update((w[:k], False) for w in own for k in lengths_up_to(len(w)))
                for t in terms if only is None else terms & only:
                    counts[t] = counts.get(t, 0) + 1
            if len(counts) > 100_000:
                yield flushed(counts)
                counts = {}
        if counts:
            yield flushed(counts)

    def flushed(counts: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts]), pa.array([w for _, w in counts]), pa.array(list(counts.values()), pa.int64())], names=["term", "whole", "n"])

    return texts.select("text").mapInArrow(counted, "term string, whole boolean, n long").groupBy("term", "whole").agg(F.sum("n").alias("n"))


def without_near_copies(texts: DataFrame) -> DataFrame:
    """Texts less those that agree in three quarters of their least shingle hashes (five words) with another, which stays."""
    seeds = np.random.default_rng(5).integers(1 << 62, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 1):
            signs = []
            for text in rows.column(1).to_pylist():
                own = np.array(shingle_hashes(text, 5) or [0], dtype=np.uint64)
                signs.append([int((own * s ^ own * s >> np.uint64(31)).min().view(np.int64)) for s in seeds])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(signs, pa.list_(pa.int64()))], names=["id", "signs"])

    signs = checkpoint(texts.select(F.xxhash64("text").alias("id"), "text").mapInArrow(signed, "id long, signs array<bigint>"))
    bands = F.array(*[F.xxhash64(F.lit(k), F.slice("signs", k + 1, 4)) for k in range(0, SIGNATURE, 4)])
    keyed = signs.select("id", "signs", F.explode(bands).alias("band"))
    first = keyed.groupBy("band").agg(F.min("id").alias("first"), F.min_by("signs", "id").alias("theirs"))
    same = F.size(F.filter(F.zip_with("signs", "theirs", lambda a, b: a == b), lambda x: x))
    near = keyed.join(first, "band").where((F.col("id") != F.col("first")) & (same >= SIGNATURE * 3 // 4)).select("id").distinct()
    return texts.join(near, F.xxhash64("text") == F.col("id"), "left_anti")


def learn_lexicon(sample: DataFrame) -> Trie:
    """The shortest pure beginnings, each carried on as long as it keeps nearly all its documents.

    Terms of enough toxic texts are counted first, then those alone in the clean ones; near copies
    of a toxic text are one witness.
    """
    sample = sample.dropDuplicates(["text", "label"])
    bad = checkpoint(without_near_copies(sample.where("label = 1")))
    toxic = {(r["term"], r["whole"]): r["n"] for r in term_counts(bad).where(F.col("n") >= SUPPORT).collect()}
    clean = {(r["term"], r["whole"]): r["n"] for r in term_counts(sample.where("label IS DISTINCT FROM 1"), set(toxic)).collect()}
    pure = sorted((t for t, n in toxic.items() if clean.get(t, 0) <= n * CLEAN_PER_TOXIC), key=lambda t: (-toxic[t], t))
    begun = {term: toxic[term, whole] for term, whole in pure if not whole}
    carried: dict[str, list[str]] = {}
    for term in begun:
        *_, before = [0, *lengths_up_to(len(term) - 1)]
        carried.setdefault(term[:before], []).append(term)
    stems: list[str] = []
    for term in sorted(begun, key=lambda t: (len(t), t)):
        if any(term[:k] in begun for k in lengths_up_to(len(term) - 1)):
            continue  # a shorter beginning is pure already
        while longer := [t for t in carried.get(term, ()) if begun[t] >= 0.95 * begun[term]]:
            term = max(longer, key=lambda t: (begun[t], t))
        stems.append(term)
    covered = set(stems)
    # whole words of which a stem is the beginning are kept where misspellings of them are looked for
    terms = [t for t, whole in pure if whole and (len(t) >= FUZZY or t in covered or not any(t[:k] in covered for k in lengths_up_to(len(t) - 1)))]
    return Trie(stems, terms, usual_words(sample.where("label IS DISTINCT FROM 1"), Trie(stems, terms)))


def usual_words(clean: DataFrame, trie: Trie) -> frozenset[str]:
    """Words near an entry that at least USUAL clean texts use."""
    shipped = clean.sparkSession.sparkContext.broadcast(trie)  # terms of a bounded sample

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 0):
            codes, before, tokens = word_table(rows.column(0), " \n")
            parts = [parts_of(t) for t in tokens]
            words = list({w for p in parts for w in p})
            close = {w for w, v in zip(words, shipped.value.words_verdicts(words), strict=True) if v == 2 and w.isalpha()}
            mine = [[w for w in p if w in close] for p in parts]
            found = [w for d in range(rows.num_rows) for w in {w for c in np.unique(codes[before[d] : before[d + 1]]) for w in mine[c]}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    counts = clean.select("text").mapInArrow(near, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r["word"] for r in counts.where(F.col("n") >= USUAL).collect())  # words of a bounded sample


def matches(texts: pa.Array, trie: Trie) -> np.ndarray:
    """Texts x kinds: matches that are said, misspelled, and quoted.

    The worker keeps the words' verdicts under the lexicon, in two generations.
    """
    verdicts_of: list[dict[str, int]] = held(("verdicts", trie.digest), lambda: [{}, {}])
    if len(verdicts_of[0]) > CACHE_WORDS:
        verdicts_of[:] = [{}, verdicts_of[0]]
    cache, older = verdicts_of
    codes, before, tokens = word_table(texts, " \n")
    for at in range(0, len(tokens), 5000):
        part = tokens[at : at + 5000]
        fresh = [t for t in part if t not in cache and t not in older]
        cache.update((t, older[t]) for t in part if t in older)
        cache.update(zip(fresh, trie.verdicts(fresh), strict=True))
    verdicts = np.array([cache[t] for t in tokens], dtype=np.int8)
    found = np.zeros((len(texts), 3))
    at = np.flatnonzero(verdicts[codes])
    docs = np.searchsorted(before, at, side="right") - 1
    for i, d in zip(at, docs, strict=True):
        kind = SAID if verdicts[codes[i]] == 1 else MISSPELLED
        left = [tokens[c] for c in codes[max(before[d], i - WINDOW) : i + 1]]
        right = [tokens[c] for c in codes[i : min(before[d + 1], i + WINDOW + 1)]]
        opened = any(t[:1] in QUOTES and t[:1] for t in left)
        closed = any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?") for t in right)
        found[d, QUOTED if opened and closed else kind] += 1
    return found


def fit_layer(found: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR so that kinds never seen keep it."""
    x = np.concatenate([np.ones((len(found), 1)), np.log1p(found)], axis=1)
    w, pull = PRIOR.copy(), np.array([0.02, 0.2, 0.2, 0.2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + pull * (w - PRIOR)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
    return w


def score_toxicity(docs: DataFrame, sample: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (in struct ``doc``), ``score`` (probability of label 1), and the
    numbers of matches ``said``, ``misspelled`` and ``quoted``.

    Null and empty texts have no match and score by the bias alone; repeated rows and ties score
    alike; empty tables give no rows; rows without an id and other columns are carried along, whatever
    their names.  Texts and words of any length are read whole, in time and memory linear in their
    length.  Without a toxic label the lexicon is empty.
    """
    spark = docs.sparkSession
    sample = checkpoint(sample)
    trie = learn_lexicon(sample)
    fitted = sample.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "text").limit(LAYER_DOCS).select("text", "label")
    shipped = spark.sparkContext.broadcast(trie)  # terms of a bounded sample
    names = ["said", "misspelled", "quoted"]

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 0):
            found = matches(rows.column(0), shipped.value)
            yield pa.RecordBatch.from_arrays([*[pa.array(found[:, k].astype(np.int64)) for k in range(3)], rows.column(1).cast(pa.int64())], names=[*names, "label"])

    layer = fitted.select("text", F.col("label").cast("bigint").alias("label")).mapInArrow(found_in, "said long, misspelled long, quoted long, label long").collect()
    weights = PRIOR
    if layer:
        weights = fit_layer(np.array([[r[n] for n in names] for r in layer], dtype=float), np.array([r["label"] == 1 for r in layer], dtype=float))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(with_text(batches, text), 1, SLICE_BYTES):
            found = matches(rows.column(1), shipped.value)
            logits = weights[0] + np.log1p(found) @ weights[1:]
            score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), *[pa.array(found[:, k].astype(np.int64)) for k in range(3)]], names=["doc", "score", *names])

    return whole.mapInArrow(scored, f"doc {whole.schema['doc'].dataType.simpleString()}, score double, said long, misspelled long, quoted long")
