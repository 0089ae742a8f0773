import hashlib
import random
from collections import Counter

import numpy as np

from palaver.llm import substrings
from palaver.llm.queries import op4_suffix_dedup
from palaver.llm.substrings import bucket_pointers, doubled, joined, remove_repeats, window_minima


def slow(texts, n=200):
    """Removed byte mask of every text by counting all strings of n bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + n]) for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d) + 1, dtype=np.int64)
        for i in range(len(d) - n + 1):
            if seen[hash(d[i : i + n])] > 1:
                mask[i] += 1
                if i + n < len(mask):
                    mask[i + n] -= 1
        out.append((d, np.cumsum(mask)[: len(d)] > 0))
    return out


def digest(d, m):
    runs = int(np.sum(m & ~np.concatenate([[False], m[:-1]]))) if len(m) else 0
    return len(d), int(m.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~m].tobytes() if len(d) else b"").hexdigest()


def digests(frame):
    got = {}
    for r in frame.collect():
        d = (r["doc"]["text"] or "").encode()
        got.setdefault(r["doc"]["doc_id"], []).append((len(d), sum(x["last"] - x["first"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return {k: sorted(v) for k, v in got.items()}


def test_identifiers_and_minima():
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    data = np.concatenate([data, data[100:900]])
    for n in (40, 128, 200):
        levels, _ = doubled(data, n)
        ids = joined(levels, n)
        assert len(ids) == len(data) - n + 1 and (ids[100:300] == ids[3000:3200]).all() == (n <= 200)
        assert len(set(ids.tolist())) == len({data[i : i + n].tobytes() for i in range(len(ids))})
    h = np.random.default_rng(0).integers(0, 50, 500)
    for w in (1, 2, 7, 64, 161):
        assert window_minima(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]


def test_bucket_pointers_are_equal_for_equal_bytes_alone():
    rng = random.Random(3)
    for alphabet in (b"ab", b"a", bytes(range(97, 123))):
        text = bytes(rng.choice(alphabet) for _ in range(1500))
        data = np.frombuffer(text + text[200:900] + text[:300] + b"x" + text[100:600], np.uint8)
        for n in (9, 40, 128, 200, 240):
            pointers = bucket_pointers(data, n)[: len(data) - n + 1]
            strings = [data[i : i + n].tobytes() for i in range(len(pointers))]
            assert len(set(zip(pointers.tolist(), strings, strict=True))) == len(set(strings)) == len(set(pointers.tolist()))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {d["doc_id"]: digest(*x) for d, x in zip(docs, slow([d["text"] for d in docs]), strict=True)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op4_suffix_dedup(spark, sf_dir).collect()}
    assert got == want


def texts_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(80))
    out = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(words))
        a = rng.randint(0, 150)
        out.append(" ".join([*words[:at], passage[a : a + rng.randint(150, 420)], *words[at:]]))
        if i % 5 == 0:
            out.append(out[-1].replace("a", "b", 1))
        if i % 7 == 0:
            out.append(out[-1])
    return [*out, None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, ("lorem ipsum dolor " * 40), passage[:200], passage[:200] + "!"]


def test_shared_passages_copies_and_periodic_texts(spark, monkeypatch):
    for seed, block in ((1, 256), (2, 4), (3, 1)):
        monkeypatch.setattr(substrings, "BLOCK", block)
        texts = texts_of(seed)
        want = {}
        for i, x in enumerate(slow(texts)):
            want.setdefault(i, []).append(digest(*x))
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert digests(remove_repeats(frame)) == want, seed


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    rows = [(1, "q" + "abc def " * 40, 5), (1, "q" + "abc def " * 40, 5), (None, "short", 5), (2, None, 5), (3, "w" * 100_000, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, k int")
    want = {}
    for (d, *_), x in zip(rows, slow([r[1] for r in rows]), strict=True):
        want.setdefault(d, []).append(digest(*x))
    assert digests(remove_repeats(frame)) == want
    assert remove_repeats(frame.limit(0)).count() == 0


def test_copies_of_a_text_show_their_contexts_once(spark, monkeypatch):
    shown, compared = spark.sparkContext.accumulator(0), substrings._compared

    def counted(length):
        own = compared(length)

        def count(batches):
            def each():
                for rows in batches:
                    shown.add(rows.num_rows)
                    yield rows

            return own(each())

        return count

    monkeypatch.setattr(substrings, "_compared", counted)
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    near = text[:1000] + "#" + text[1001:]
    texts = [text] * 60 + [near]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc"]["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert [(r["first"], r["last"]) for r in rows[60]["removed"]] == [(0, 1000), (1001, 2000)]
    assert all([(r["first"], r["last"]) for r in rows[i]["removed"]] == [(0, 2000)] for i in range(60))
    assert 0 < shown.value < 60


def test_copies_of_a_text_show_its_contexts_once(spark, monkeypatch):
    """The contexts that are compared don't grow with the copies of a text."""
    rng = random.Random(12)
    text = " ".join(f"word{rng.randrange(900)}" for _ in range(400))
    near = [text[:1500] + "!" + text[1501:], text[:700] + "?" + text[701:]]
    seen = []
    true = substrings._contexts
    counts = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in true(batches):
            counts.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(substrings, "_contexts", counted)
    for copies in (1, 1000):
        before = counts.value
        rows = [(i, text) for i in range(copies)] + [(10_000 + i, t) for i, t in enumerate(near)]
        got = digests(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
        want = {d: [digest(*x)] for (d, _), x in zip(rows, slow([t for _, t in rows]), strict=True)}
        assert got == want
        seen.append(counts.value - before)
    assert 0 < seen[1] <= seen[0]
