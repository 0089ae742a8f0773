"""The index of vectors against a scan of all of them."""

import numpy as np
import pytest

from palaver.operators import retrieval, vector_index
from palaver.sources import tables


@pytest.fixture(scope="module")
def rows():
    """Groups of vectors around far centres, copies, and vectors that can't be compared."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    out = [(i, [float(x) for x in centres[i % 30] + rng.normal(scale=0.15, size=24)]) for i in range(4000)]
    out += [(4000 + i, out[7][1]) for i in range(200)]
    return out + [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [1.0, 2.0]), (5004, [float("inf")] + [0.0] * 23)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    vector_index.build(frame, path, "id", "v", 60)
    return frame, path


def scan(frame, query, most):
    usable = frame.where("v IS NOT NULL AND size(v) = 24 AND id <> 5004")
    return [tuple(r) for r in retrieval.nearest(usable, "id", "v", query, most).collect()]


def test_search_equals_the_scan(spark, rows, index):
    frame, path = index
    rng = np.random.default_rng(2)
    queries = [rows[7][1], rows[123][1], [float(x) for x in rng.normal(size=24)], [-x for x in rows[3][1]]]
    for q in queries:
        for most in (1, 10, 300):
            assert [tuple(r) for r in vector_index.search(spark, path, q, most).collect()] == scan(frame, q, most)


def test_few_cells_and_files_are_read(spark, rows, index):
    frame, path = index
    q = rows[123][1]
    first, others = vector_index.plan(spark, path, q, 10)
    found = vector_index.search(spark, path, q, 10)
    left, _ = vector_index.within(others, found.collect()[-1]["score"])
    assert len(first) + len(left) <= 8 < (len(first) + len(others)) / 4
    files = spark.read.schema(vector_index.VECTORS).parquet(f"{path}/vectors")
    read = files.where(files["cell"].isin([c.cell for c in first + left])).inputFiles()
    assert sum(f"cell={c.cell}/" in f for f in set(read) for c in first + left) <= len(files.inputFiles()) / 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or not left


def test_scope_holds_before_the_best_are_taken(spark, rows, index):
    frame, path = index
    even = [r[0] for r in rows if r[0] % 2 == 0]
    scope = spark.createDataFrame([(i,) for i in even], "id long")
    got = [tuple(r) for r in vector_index.search(spark, path, rows[8][1], 25, scope).collect()]
    assert got == scan(frame.where("id % 2 = 0"), rows[8][1], 25)


def test_queries_without_an_answer_and_empty_tables(spark, index, tmp_path):
    _, path = index
    assert vector_index.search(spark, path, [0.0] * 24, 5).collect() == vector_index.search(spark, path, [1.0], 5).collect() == []
    vector_index.build(spark.createDataFrame([(1, None)], "id long, v array<double>"), f"{tmp_path}/e", "id", "v")
    assert vector_index.search(spark, f"{tmp_path}/e", [1.0], 5).collect() == []


def test_embedded_messages(spark):
    index = tables.conform(spark.createDataFrame([(i, i == 2) for i in range(1, 6)], "message_id long, hidden boolean"), "message_index")
    rows = [(1, "m", "done", [1.0]), (2, "m", "done", [1.0]), (3, "m", "pending", None), (4, "other", "done", [1.0]), (5, "m", "done", None)]
    frame = spark.createDataFrame(rows, "message_id long, embedding_model string, embedding_status string, embedding_vector array<double>")
    assert [r[0] for r in vector_index.embedded(index, frame, "m").collect()] == [1]
