"""Operator 13 against all distances computed at once, in Python's own integers where it matters."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import vector_codes as V
from palaver.llm.queries import ORACLE_SQL, op13_vector_codes


def slow(rows, parts=4, entries=256, rounds=4):
    """(id, code, error, label_error) of (id, vector, label) rows, and the codebooks' digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = -(-max(len(r[1]) for r in kept) // parts) * parts
    ints = np.array([[int(np.floor(1024 * float(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in kept], dtype=object).reshape(len(kept), width)
    cuts = np.split(ints, parts, axis=1)
    books = [c[:entries].copy() for c in cuts]

    def assigned():
        gaps = [((c[:, None, :] - b[None]) ** 2).sum(axis=2) if c.shape[1] else np.zeros((len(c), len(b)), dtype=object) for c, b in zip(cuts, books)]
        index = [np.array([min(range(len(row)), key=lambda i: (row[i], i)) for row in g]) for g in gaps]
        return index, sum(np.array([row[i] for row, i in zip(g, at)]) for g, at in zip(gaps, index))

    for _ in range(rounds):
        index, _ = assigned()
        for c, b, at in zip(cuts, books, index):
            for e in set(at.tolist()):
                b[e] = c[at == e].sum(axis=0) // int((at == e).sum())
    index, error = assigned()
    by = {}
    for r, e in zip(kept, error):
        by[r[2]] = by.get(r[2], 0) + e
    codes = ["".join(f"{at[i]:02x}" for at in index) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], c, e, by[r[2]]) for r, c, e in zip(kept, codes, error)), key=str), digest


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    codes, books = V.compress(frame, **more)
    return sorted(((r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in codes.collect()), key=str), books.digest()


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(0, 20), st.sampled_from([1, 3, 2000, 1 << 20, 1 << 27]), st.integers(0, 10**6))
def test_nearest_entry_is_exact(n, k, width, reach, seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-reach, reach + 1, (n, width)), rng.integers(-reach, reach + 1, (k, width))
    index, distance = V.nearest(x, book)
    every = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_odd_rows_equal_brute_force(spark):
    """Nulls, missing and infinite components, repeated ids and rows, several lengths, null labels."""
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 11 else None, [float(x) for x in rng.normal(0, 0.3, 10 if i % 7 else 6)], int(i % 3) if i % 4 else None) for i in range(120)]
    rows += rows[:9] + [(3, rows[8][1], 1), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 10, None), (503, [float("inf")] + [0.0] * 9, 2), (504, [], 2)]
    assert run(spark, rows, entries=16) == slow(rows, entries=16)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, [i / 7.0, -i / 3.0, 0.1, 1e-9], None) for i in range(5)]
    assert run(spark, rows) == slow(rows)
    assert run(spark, [(1, None, 1)]) == run(spark, []) == ([], hashlib.sha256(b"").hexdigest())


def test_copies_of_the_sums_for_many_labels_change_nothing(spark, monkeypatch):
    rows = [(i, [float(i % 13), float(i % 5), 0.5, -0.5], i % 9 if i % 9 else None) for i in range(300)]
    want = run(spark, rows, entries=8)
    monkeypatch.setattr(V, "BROADCAST_GROUPS", 3)
    assert run(spark, rows, entries=8) == want == slow(rows, entries=8)


def test_huge_components_count_as_the_largest(spark):
    rows = [(1, [1e300, -1e300, 0.0, 1.0], 1), (2, [0.0, 0.0, 0.0, 1.0], 1)]
    got, _ = run(spark, rows, entries=1)
    assert [r[:2] for r in got] == [(1, "00000000"), (2, "00000000")] and all(r[2] > 0 for r in got)


def test_codes_stand_for_vectors_about_as_far_as_their_error(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = V.fit(vectors)
    back = V.decode(V.encode(vectors.select("vec_id", F_copy("embedding"), "embedding"), books), books).collect()
    for r in back[:50]:
        ints = np.floor(np.array(r["row"]["kept"], dtype=np.float64) * 1024)
        assert ((ints - np.array(r["approximate"]) * 1024) ** 2).sum() == pytest.approx(r["error"])
    assert V.codebook_table(spark, books).count() == 4 * 256


def F_copy(name):
    from pyspark.sql import functions as F

    return F.col(name).alias("kept")


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    frame = op13_vector_codes(spark, sf_dir)
    cursor = con.execute(ORACLE_SQL["op13_vector_codes"])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, frame.select(names).collect())) == sorted(cursor.fetchall())
