"""Queries and operators on inputs that earlier forms of them got wrong."""

import duckdb
from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.operators import fulltext
from palaver.plans import catalogue
from palaver.plans import records  # noqa: F401
from palaver.sources.runs import Runs


def both(spark, name, sf_dir, *tables):
    """The rows of a query and of its SQL over written tables, sorted."""
    frame = catalogue.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    places = [d[0] for d in cursor.description]
    theirs = sorted((tuple(r[places.index(c)] for c in frame.columns) for r in cursor.fetchall()), key=str)
    return sorted(map(tuple, frame.collect()), key=str), theirs


def test_edit_kinds_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    texts = ["asé it may be", "as it may be", None, "remove one\rthing", "remove one thing", "remove one\nthing", "édeleteé it", "get\u000brid of", "get rid of", "delete İtem", "REMOVE İTEM", "style Kof", ""]
    rows = [(i, turn, "user", t) for i, t in enumerate(texts) for turn in (0, 1, 2, 3, 4, -1, -3, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    mine, theirs = both(spark, "edit_kind", str(tmp_path), "conversations")
    assert mine == theirs


def test_query_tokens_of_one_character_count(spark, tmp_path):
    rows = [(1, "Fix a B fix b C++"), (2, "x"), (3, None), (4, " ".join(map(str, range(30))))]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mine, theirs = both(spark, "query_tokens", str(tmp_path), "benchmark")
    assert mine == theirs and mine[0] == (1, "Fix a B C") and mine[1] == (2, "x")


def test_query_tokens_are_those_of_the_whole_text(spark, tmp_path):
    letters, words = "abcdefghijklmnopqrstuvwxyz", [f"Word{i}" for i in range(3000)]
    texts = [" ".join(letters) + " Later A later z1", " ".join(["x"] * 30) + " y", " ".join(words + [w.upper() for w in reversed(words)]), "b B a A", "é,ü!", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mine, theirs = both(spark, "query_tokens", str(tmp_path), "benchmark")
    assert mine == theirs
    assert [t for _, t in mine] == [" ".join(letters) + " Later z1", "x y", " ".join(words), "b a", "", "", None]
    searched = spark.range(1).select(X.query_tokens(F.lit(texts[2]))).first()[0]
    assert searched == words[:24]  # searches keep their limit


def test_waits_of_dense_requests_by_whatever_spans(spark):
    from datetime import datetime, timedelta, timezone

    from palaver.operators import limits

    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    seconds = [(i * 37) % 400 + (i % 3) * 60 for i in range(300)] + [10, 10, 10, 70, 70]
    rows = [(i if i < 300 else 7, zero + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    order = sorted((s, k[0]) for s, k in zip(seconds, rows, strict=True))
    slow = []
    for i, (s, k) in enumerate(order):
        window = [u for u, _ in order if s - 60 < u <= s]
        before = i - sum(u <= s - 60 for u, _ in order)
        slow.append((k, float(window[0] + 60 - s) if before >= 5 else 0.0))
    frame = spark.createDataFrame(rows, "k long, at timestamp").repartition(3)
    for size in (1_000_000, 20):
        found = limits.waits(frame, "at", "k", 60, 5, size)
        assert sorted(map(tuple, found.collect())) == sorted(slow)
    # earlier: a sliding minimum, which walks the whole window for each request
    assert "specifiedwindowframe(RangeFrame" not in limits.waits(frame, "at", "k")._jdf.queryExecution().optimizedPlan().toString()


def test_a_table_block_computes_its_cells_once(spark):
    from pyspark.sql import functions as F

    from palaver.operators import markup

    plan = spark.range(1).select(markup.table_block(F.concat(F.col("id"), F.lit("|a"))).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # lines, and a line's cells; earlier once for each use


def test_unindexed_bm25_reads_texts_once(spark):
    from palaver.operators import retrieval

    docs = spark.createDataFrame([(1, "a token here"), (2, None), (3, "token token"), (4, "x"), (5, "y"), (6, "z")], "id long, t string")
    found = retrieval.bm25(docs, "id", "t", "token", 5)
    assert [r["id"] for r in found.collect()] == [3, 1]
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()  # earlier in each term of a filter


def test_postings_stay_with_their_texts(spark, tmp_path, monkeypatch):
    """Each file has the places of some texts, in order of the terms' hashes: none of them is shuffled."""
    monkeypatch.setattr(fulltext, "TASK_BYTES", 400)
    rows = [(i, "upsert", i, f"common word{i} other common", "Zoë B") for i in range(60)]
    path = f"{tmp_path}/i"
    fulltext.apply_changes(spark.createDataFrame(rows, "seq long, op string, message_id long, content string, author_name string"), path, 0)
    files = {}
    for r in Runs(spark, path).read("postings", fulltext.POSTINGS, Runs(spark, path).live()).withColumn("file", F.input_file_name()).collect():
        files.setdefault(r["file"], []).append(r)
    assert len(files) > 2 and sum(len({r["key"] for r in f}) for f in files.values()) == 60 and sum(map(len, files.values())) == 360
    assert all([r["digest"] for r in f] == sorted(r["digest"] for r in f) for f in files.values())
    assert {r["place"] for r in files[min(files)] if r["term"] in ("common", "zoe")} == {0, 3, fulltext.FIELD_STEP}
