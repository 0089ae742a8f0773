import itertools
import random

import numpy as np
import pytest
import xxhash

from palaver.llm import simhash
from palaver.llm.graph import connected_components, forest
from palaver.llm.queries import op1_simhash
from palaver.llm.simhash import block_size, covering_blocks, deduplicated, most_bits, near_duplicate_groups, near_links, random_blocks, shingle_hashes, wide_fingerprint

WHITE = " \t\n\r\x0b\x0c"


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_groups(ids, fps):
    """Union-find over all pairs at distance <= 4."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    array = np.array(fps, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= 4) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_every_four_positions_hold_a_block():
    blocks = covering_blocks()
    assert len(blocks) == 20
    assert all(any(set(b) <= set(q) for b in blocks) for q in itertools.combinations(range(8), 4))
    assert set(covering_blocks(size=4)) == set(itertools.combinations(range(8), 4))
    assert [block_size(n) for n in (0, 10**6, 10**7, 10**8, 10**11)] == [3, 3, 3, 4, 4]


def test_query_against_all_pairs(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op1_simhash(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [slow_fingerprint(d["text"]) for d in docs]
    assert [int(rows[d["doc_id"]]["fingerprint"], 16) for d in docs] == fps and len(rows) == len(docs)
    assert [rows[d["doc_id"]]["component_id"] for d in docs] == slow_groups([d["doc_id"] for d in docs], fps)


@pytest.mark.parametrize("size", [3, 4])
@pytest.mark.parametrize("most", [4096, 4])
def test_links_have_the_components_of_all_pairs_even_under_hot_keys(spark, monkeypatch, most, size):
    monkeypatch.setattr(simhash, "MOST_UNDER_KEY", most)
    monkeypatch.setattr(simhash, "block_size", lambda n: size)
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fp = centre
            for _ in range(rng.randint(0, 5)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    links = near_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    parts = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = slow_groups(signed, fps)
    assert [parts.get(s, s) for s in signed] == want


def test_odd_rows(spark):
    text = "a quick brown fox jumps over the lazy dog"
    rows = [(7, text), (3, text.upper()), (3, text), (9, None), (5, ""), (8, " \n\t"), (None, text), (11, "three words only"), (12, "w " * 60_000), (13, "NBSP is no space here")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, doc int")
    got = near_duplicate_groups(docs).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(((d, f, c) for (d, _), f, c in zip(rows, fps, slow_groups([d for d, _ in rows], fps), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want
    assert near_duplicate_groups(docs.limit(0)).count() == 0


def test_components_of_long_chains_stars_and_none(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1400)] + [(5000, 5000 + i) for i in range(1, 300)] + [(1, 1)] + [(rng.randrange(10_000, 10_200), rng.randrange(10_000, 10_200)) for _ in range(120)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    nodes, roots = forest(a, b)
    want = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert {k: v for k, v in got.items() if k != v} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    a, b = set(shingle_hashes(a, 5)), set(shingle_hashes(b, 5))
    return len(a & b) / len(a | b)


def edited(rng, words, share):
    return " ".join(rng.choice(("new", "other", "odd")) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words)


def kept_by_all_pairs(rows, most):
    """Of (id, text) those that stay: wide fingerprints of all pairs, components, the least id."""
    fps = np.array([np.array(wide_fingerprint(shingle_hashes(t or "", 5)), dtype=np.int64).view(np.uint64) for _, t in rows])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(fps[i] ^ fps[j]).sum() <= most:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {min(d for (d, _), x in zip(rows, label, strict=True) if x == c) for c in set(label)}


def test_near_copies_of_a_similarity_of_four_fifths(spark):
    rng = random.Random(8)
    rows, pairs = [], []
    for i in range(0, 600, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        other = edited(rng, words, rng.choice([0.005, 0.01, 0.02, 0.03, 0.3]))
        rows += [(i, " ".join(words)), (i + 1, other)]
        pairs.append((i + 1, jaccard(" ".join(words), other)))
    kept = {r["doc_id"] for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in range(0, 600, 2)} <= kept  # different texts stay
    near, nearer, far = ([i not in kept for i, s in pairs if a <= s < b] for a, b in ((0.8, 0.9), (0.9, 1.01), (0, 0.6)))
    assert min(len(near), len(nearer), len(far)) > 30
    assert np.mean(near) >= 0.95 and np.mean(nearer) >= 0.99 and np.mean(far) <= 0.02
    want = kept_by_all_pairs(rows, most_bits(0.8))
    assert len(kept ^ want) <= 0.02 * len(rows)


def test_one_of_a_large_group_stays_whatever_the_keys_hold(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, edited(rng, words, 0.004)) for i in range(10, 400)] + [(i, "other " + " ".join(f"x{rng.randrange(5000)}" for _ in range(60))) for i in range(400, 420)]
    want = {10, *range(400, 420)}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in deduplicated(frame).collect()} == want
    monkeypatch.setattr(simhash, "MOST_UNDER_KEY", 20)
    assert {r["doc_id"] for r in deduplicated(frame).collect()} == want


def test_blocks_meet_as_often_as_they_should():
    rng = np.random.default_rng(3)
    for rows in (1000, 1 << 26):
        differs = rng.random((4000, 64, 8)) < 0.1515
        same = ~differs.any(axis=2)
        met = np.any([same[:, list(b)].all(axis=1) for b in random_blocks(rows, 0.8)], axis=0)
        assert met.mean() >= 0.975


def test_deduplication_of_odd_rows(spark):
    text = "a quick brown fox jumps over the lazy dog"
    rows = [(7, text), (3, text.upper()), (3, text), (3, text), (9, None), (5, ""), (None, text), (11, "three words only"), (12, "w " * 60_000), (None, "alone without an id here")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, body int, w0 int")
    got = deduplicated(docs).collect()
    assert [list(r.asDict()) for r in got] == [["doc_id", "text", "body", "w0"]] * len(got)
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([3, 5, 11, 12, None], key=str)
    assert deduplicated(docs.limit(0)).count() == 0


def test_pairs_at_the_similarity_itself(spark):
    """Sets of shingles of exactly four fifths: nine in ten are found, and hardly any at three fifths."""
    rng = random.Random(12)

    def pair(shared, own):
        a = [f"a{rng.randrange(10**9)}" for _ in range(shared)]
        return [" ".join(a + [f"b{rng.randrange(10**9)}" for _ in range(own)]), " ".join(a + [f"c{rng.randrange(10**9)}" for _ in range(own)])]

    found = {}
    for name, shared, own in (("at", 404, 50), ("below", 304, 100)):
        pairs = [pair(shared, own) for _ in range(250)]
        rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
        kept = {r["doc_id"] for r in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        found[name] = np.mean([2 * i + 1 not in kept for i in range(250)])
        assert jaccard(*pairs[0]) == pytest.approx(0.8 if name == "at" else 0.6, abs=1e-9)
    assert found["at"] >= 0.9 and found["below"] <= 0.02
