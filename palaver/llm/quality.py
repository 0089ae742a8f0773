"""Quality classifier: averaged hashed subword embeddings with a softmax output.

Each word gives its own hash, its character n-grams, the pair with the word before it, and a mark
where it repeats that word; each feature has a learned vector; a document is the mean of its
features' vectors, and a softmax layer scores it.  Vectors and layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled documents.

For scoring, every vector is multiplied with the output layer once, so a feature is one number and
a document's logit the mean of its features' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import text_slices, word_table
from palaver.llm.subwords import MIX, char_grams, mixed, sums_by, word_hashes

SAMPLE_DOCS = 5000
BUCKETS = 1 << 16
DIM = 8
EPOCHS = 4
SAME = np.uint64(77)


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; buckets of their subword features and the words those belong to."""
    hashes = word_hashes(words)
    grams, owner = char_grams(words, 2, 4) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ids = np.concatenate([hashes, grams]) % np.uint64(buckets)
    return hashes, ids.astype(np.int64), np.concatenate([np.arange(len(words)), owner])


def pair_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each neighbouring pair in a row of word hashes; all repeats share one."""
    left, right = hashes[:-1], hashes[1:]
    pairs = np.where(left == right, SAME, mixed(left * MIX + right))
    return (pairs % np.uint64(buckets)).astype(np.int64)


def document_features(text: str, buckets: int) -> np.ndarray:
    words = text.replace("\n", " ").split(" ")
    hashes, ids, _ = word_features(words, buckets)
    return np.concatenate([ids, pair_buckets(hashes, buckets)])


def train(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """A number for each feature bucket, and a bias: the logit of label 1."""
    rng = np.random.default_rng(seed)
    classes = 2
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    layer, bias = np.zeros((dim, classes)), np.zeros(classes)
    docs = []
    for text in texts:
        ids, counts = np.unique(document_features(text, buckets), return_counts=True)
        docs.append((ids.astype(np.int32), (counts / counts.sum()).astype(np.float32)))
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, shares = docs[i]
            now = rate * (1 - done / steps)
            mean = shares @ vectors[ids]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= now * p * 0.1
            # a feature's step is scaled up from its share, as averaged gradients are tiny
            vectors[ids] -= now * np.outer(np.minimum(1.0, shares * 30), back)
            done += 1
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the labels to the logits (Newton's method)."""
    x, w = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - labels) + 1e-2 * (w - np.array([1.0, 0.0])))
    return float(max(w[0], 1e-3)), float(w[1])


def slice_logits(texts: pa.Array, numbers: np.ndarray, bias: float) -> np.ndarray:
    codes, before, words = word_table(texts, " \n")
    buckets = len(numbers)
    hashes, ids, owner = word_features(words, buckets)
    sums, counts = sums_by(owner, numbers[ids], len(words)), np.bincount(owner, minlength=len(words))
    pairs = numbers[pair_buckets(hashes[codes], buckets)]
    pairs = np.append(pairs, 0.0)
    pairs[before[1:] - 1] = 0.0  # the last word of a text has no next one
    total = np.add.reduceat(sums[codes] + pairs, before[:-1])
    count = np.add.reduceat(counts[codes], before[:-1]) + np.diff(before) - 1
    return total / count + bias


def fit(sample: DataFrame, bound: int = SAMPLE_DOCS) -> tuple[np.ndarray, float, float, float]:
    """Train on a bounded (doc_id, text, label) sample; a tenth of it sets the final calibration.

    Without labels of both classes every score is the share of label 1 (0.5 without any).
    """
    rows = sorted(sample.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "text", "label").limit(2 * bound).select("doc_id", "text", "label").collect(), key=lambda r: (str(r["doc_id"]), r["text"]))
    labels = np.array([int(r["label"] == 1) for r in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share)))
    rng = np.random.default_rng(1)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 10] if len(rows) >= 200 else order
    own = order[len(held) :] if len(rows) >= 200 else order
    numbers, bias = train([rows[i]["text"] for i in own], labels[own])
    logits = slice_logits(pa.array([rows[i]["text"] for i in held]), numbers, bias)
    return numbers, bias, *calibrated(logits, labels[held])


def score_quality(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row; score is the probability of label 1.

    Null texts count as empty and an empty text scores by its one empty word; ties and repeated
    rows get equal scores; rows without an id are scored like others; texts of any length are read
    whole, one at a time where they are long; an empty table gives no rows; other columns are not read.
    """
    numbers, bias, slope, shift = fit(sample)
    model = docs.sparkSession.sparkContext.broadcast(numbers.astype(np.float32))  # one number per bucket
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 1, 3 << 20):
            logits = slope * slice_logits(rows.column(1), model.value, bias) + shift
            score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return slim.mapInArrow(scored, schema)
