import hashlib
import random
import re
import time

import pytest

from palaver.llm import decontamination
from palaver.llm.decontamination import decontaminate
from palaver.llm.queries import op5_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[g]
        listed = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf_dir):
    got = sorted(map(tuple, op5_decontamination(spark, sf_dir).collect()), key=str)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == brute(docs, items)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("broadcast, fewest, most", [(64 << 20, 1 << 16, 1 << 26), (0, 4, 4), (64 << 20, 8, 1 << 26)])
def test_odd_rows(spark, monkeypatch, broadcast, fewest, most):
    """By a broadcast set; by a shuffled one behind filters that are full, where hashes meet first; behind tight filters."""
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(decontamination, "FEWEST_SLOTS", fewest)
    monkeypatch.setattr(decontamination, "MOST_SLOTS", most)
    ten = "a b c d e f g h i j"
    items = [(1, "Short Item"), (2, ten), (3, ten + " k"), (4, None), (5, ".,"), (None, "nameless words"), (11, ten)]
    docs = [
        (1, f"x {ten.upper()}, k y", "en"), (1, f"x {ten.upper()}, k y", "en"), (2, None, None), (3, "", "en"), (None, "a short-item! Nameless words", "de"),
        (4, "ÀÉ " * 50_000 + "short item", "en"), (5, "a b c d e f g h i", "en"), (6, "short item short item", "en"), (None, None, None),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, hash string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(frame, bench).collect()
    got = []
    for r in out:
        got.append((r["doc"]["doc_id"], r["n_words"], len(r["hit_words"]), len(r["item_ids"]), hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest(), bool(r["hit_words"])))
    assert sorted(got, key=str) == brute([d[:2] for d in docs], items)
    clean = {r["doc"]["doc_id"]: r["clean_text"] for r in out if r["doc"]["doc_id"] in (1, 5, 6)}
    assert clean == {1: "x y", 5: "a b c d e f g h i", 6: ""}
    assert {r["doc"]["hash"] for r in out} == {"en", "de", None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["hit_words"] for r in decontaminate(docs, items.limit(0)).collect()] == [[]]


def test_filters_grow_with_the_benchmark(spark, sf_dir, tmp_path, monkeypatch):
    """Many items leave few windows of the documents, and the rows are those of brute force."""
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300).collect()]
    vocabulary = sorted({w for _, t in docs for w in words(t)})
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(20_000)] + [(50_000 + i, " ".join(words(t)[5:17])) for i, t in docs[:40]]
    written, real = [], decontamination.scratch

    def noted(session, name):
        written.append(real(session, name))
        return written[-1]

    monkeypatch.setattr(decontamination, "scratch", noted)
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = [(r["doc"]["doc_id"], r["n_words"], len(r["hit_words"]), len(r["item_ids"]), hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest(), bool(r["hit_words"])) for r in out]
    assert sorted(got, key=str) == brute(docs, items)
    windows = spark.read.parquet(next(p for p in written if "windows" in p))
    passed = windows.selectExpr("sum(size(windows))").first()[0]
    true = spark.read.parquet(next(p for p in written if "hits" in p)).count()
    assert passed - true < 0.02 * sum(r["n_words"] for r in out)


def test_a_window_of_very_many_items(spark):
    items = [(i, "one two three four five six seven eight nine ten") for i in range(3000)]
    docs = [(i, "zero " + items[0][1] + " eleven" * 20 + " " + items[0][1]) for i in range(20)]
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(len(r["item_ids"]) == 3000 and len(r["hit_words"]) == 20 for r in out)


@pytest.mark.parametrize("piece", [".", ". ", "a.", "a", "é-"])
def test_long_texts_are_cut_in_linear_time(spark, piece):
    text = (piece * 400_000)[:400_000] + " short item " + (piece * 400_000)[:400_000]
    began = time.perf_counter()
    row = decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "short item")], "item_id long, text string")).first()
    kept, end = [], 0
    for i, m in enumerate(re.finditer(decontamination.RAW_WORD, text)):
        kept += [] if i in row["hit_words"] else [text[end : m.end()]]
        end = m.end()
    assert len(row["hit_words"]) == 2 and row["clean_text"] == "".join(kept) + text[end:] and time.perf_counter() - began < 60
