"""Hashed features of words: the word itself and its character n-grams, for many words at once."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)
START, END = 2, 3  # code points that mark a word's ends


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between START and END, and each word's length with them."""
    joined = "".join([f"{chr(START)}{w}{chr(END)}" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return codes, np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash for each word."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes, lengths = code_points(words)
    ends = np.cumsum(lengths)
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), STEP, dtype=np.uint64))
    return mixed(np.add.reduceat(mixed(codes) * powers[place], ends - lengths))


def char_grams(words: list[str], shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character n-grams (ends marked), and the word each belongs to."""
    codes, lengths = code_points(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    grams, owners, h = [], [], mixed(codes)
    for n in range(1, longest + 1):
        if n > 1:
            h = mixed(h[:-1] * STEP + codes[n - 1 :])
        if n >= shortest:
            inside = owner[: len(h)] == owner[n - 1 :] if n > 1 else np.ones(len(h), dtype=bool)
            if n == 1:
                inside = codes > END
            grams.append(h[inside] + np.uint64(n))
            owners.append(owner[: len(h)][inside])
    return np.concatenate(grams), np.concatenate(owners)


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)
