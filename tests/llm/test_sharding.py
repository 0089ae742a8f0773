import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from palaver.llm import sharding
from palaver.llm.queries import op7_hilbert_shards
from palaver.llm.sharding import hilbert_index, hilbert_shards, text_bounds, write_shards


def law_holds(rows, shards=40):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for v in slots.values():
        assert sorted(v) == list(range(len(v)))


def test_curve_visits_every_cell_once_and_steps_to_a_neighbour(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        axes = [f"x{i}" for i in range(n)]
        cells = spark.range(1 << (n * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias(a) for i, a in enumerate(axes)])
        path = sorted(cells.select(hilbert_index(axes, bits).alias("h"), *axes).collect())
        assert [r["h"] for r in path] == list(range(1 << (n * bits)))
        assert all(sum(abs(a[x] - b[x]) for x in axes) == 1 for a, b in zip(path, path[1:], strict=False))


def test_query_keeps_the_row_law_over_the_whole_table(spark, sf_dir):
    rows = op7_hilbert_shards(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    law_holds(rows)
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode())
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_shards_are_narrow_in_the_dimensions(spark, sf_dir):
    placed = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["source", "lang", "n_chars"], "doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    per = placed.join(docs, "doc_id").groupBy("shard").agg(F.count_distinct("source").alias("s"), F.count_distinct("lang").alias("l")).collect()
    sources, languages = (sum(r[k] for r in per) / len(per) for k in "sl")
    assert sources < 13 and languages < 4 and sources * languages < 20


def test_nulls_empty_texts_copies_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, 1), (1, "", "a", 2), (1, "", "a", 2), (2, "x" * 300_000, None, 3), (3, "é", "b", 4)] + [(100 + i, "same", "hot", 5) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    out = hilbert_shards(docs, ["source", "shard"], "doc_id").collect()
    assert len(out) == len(rows)
    law_holds(out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert hilbert_shards(docs, ["source"], "doc_id").count() == 0


def test_text_dimensions_are_told_apart_behind_a_common_beginning(spark):
    rows = [(i, "t", f"https://host{i % 20:02d}.example") for i in range(2000)] + [(5000, "t", "a"), (5001, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bounds = text_bounds(docs, "source", 4)
    assert bounds == [f"https://host{k:02d}.example" for k in (4, 9, 14)]
    placed = hilbert_shards(docs, ["source", "doc_id"], "doc_id", num_shards=16).join(docs, "doc_id")
    per = [r["n"] for r in placed.groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()]
    assert sum(per) / len(per) < 10  # of 20


def test_ranks_along_the_curve_against_an_independent_one(spark, sf_dir):
    """Cells by the query's dimensions in the order of a curve that is computed by rotating squares, not by bits."""
    rows = [(i, "t", i % 16, i // 16 % 16) for i in range(16 * 16 * 6)]  # each bin is a value
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int, y int")
    placed = {r["doc_id"]: r for r in hilbert_shards(docs, ["x", "y"], "doc_id", bits=4).collect()}

    def along(x, y, n=16):
        d, s = 0, n // 2
        while s:
            rx, ry = int(x & s > 0), int(y & s > 0)
            d += s * s * ((3 * rx) ^ ry)
            if not ry:
                if rx:
                    x, y = n - 1 - x, n - 1 - y
                x, y = y, x
            s //= 2
        return d

    ranks = [placed[r[0]]["rank"] for r in rows]
    assert sorted(ranks) == list(range(len(rows)))
    ordered = sorted(rows, key=lambda r: placed[r[0]]["rank"])
    follows = []
    for first, second in ((2, 3), (3, 2)):  # the curve may begin along either axis, in any corner
        for u, v in ((0, 0), (0, 15), (15, 0), (15, 15)):
            cells = [along(r[first] ^ u, r[second] ^ v) for r in ordered]
            follows.append(cells in (sorted(cells), sorted(cells, reverse=True)))
    assert any(follows)


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, "no id", 7), (None, None, 7), (1, "twice", 1), (1, "twice", 1), (1, "other", 2)] + [(i, f"text {i}", i) for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    placed = hilbert_shards(docs, ["shard"], "doc_id", num_shards=8)
    write_shards(docs, placed, "doc_id", f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in back) == Counter(rows)
    law_holds([{"shard": r["_shard"], "slot": r["_slot"]} for r in back], 8)


def test_bounds_of_text_columns_are_the_same_by_either_way(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "é", "世", "b" * 50, ""]) + str(rng.randrange(60)) if rng.random() > 0.1 else None, rng.choice(["x", "x", "x", "y", None])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "c0 string, c1 string")
    few = sharding.all_text_bounds(frame, ["c0", "c1"], 16)
    monkeypatch.setattr(sharding, "FEW_VALUES", 3)
    assert sharding.all_text_bounds(frame, ["c0", "c1"], 16) == few and len(few["c0"]) == 15 and few["c1"] == ["x"]
    assert sharding.all_text_bounds(frame.limit(0), ["c0"], 16) == {"c0": []} and sharding.all_text_bounds(frame, [], 4) == {}
