import math
import random
import re
import unicodedata
from datetime import datetime, timedelta

import pytest

from palaver.operators import fulltext, limits
from palaver.operators.retrieval import bm25
from palaver.sources.runs import Run, Runs
from palaver.streaming.index import change_log, compact, current_index, live_batches, maintain_index, windowed_counts
from palaver.streaming.limiter import admit_stream

T0 = datetime(2024, 5, 1, 12)


EVENTS = "seq long, op string, message_id long, content string, author_name string, attachment_summary string"


def test_index_follows_the_stream_and_repeated_events_do_no_harm(spark, tmp_path):
    src, index, check = (f"{tmp_path}/{x}" for x in ("src", "index", "check"))
    schema = "seq long, op string, message_id long, content string, ts timestamp"
    spark.createDataFrame([(1, "upsert", 1, "first", T0), (2, "upsert", 2, "second", T0)], schema).coalesce(1).write.parquet(src)
    maintain_index(change_log(spark, src), index, check).awaitTermination()
    spark.createDataFrame([(2, "upsert", 2, "second", T0), (3, "delete", 2, None, T0), (4, "upsert", 2, "late edit", T0), (5, "hide", 1, None, T0)], schema).coalesce(1).write.mode("append").parquet(src)
    maintain_index(change_log(spark, src), index, check).awaitTermination()
    rows = {r["message_id"]: (r["hidden"], r["deleted"], r["content_text"]) for r in current_index(spark, index).collect()}
    assert rows == {1: (True, False, "first"), 2: (True, True, "late edit")}


WORDS = ["auth", "lunch", "Café", "naïve", "Привет", "й", "世界", "the", "fix-me", "x2"]


def drawn_events(rng, n, ids, first=1):
    """Events of all kinds in an order of their own; some keys get no upsert."""
    out = []
    for seq in range(first, first + n):
        op = rng.choice(["upsert"] * 5 + ["hide", "unhide", "delete"])
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) if op == "upsert" else None
        out.append((seq, op, rng.randrange(ids), text, rng.choice(["Zoë Auth", "bob", None]) if op == "upsert" else None, rng.choice(["lunch.png (image/png)", ""]) if op == "upsert" else None))
    return out


def plain_words(text):
    low = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", low)


def slow_search(events, query, fields=(0, 1, 2)):
    """{key: score} by BM25 over the visible messages, from the events alone."""
    state = {}
    for _, op, key, text, author, files in sorted(events):
        row = state.get(key)
        if op == "upsert" and (text or "").strip():
            state[key] = {"hidden": False, "deleted": False} | (row or {}) | {"fields": [" ".join(text.split()), author, files]}
        elif row and op == "delete":
            row.update(deleted=True, hidden=True)
        elif row and op in ("hide", "unhide"):
            row["hidden"] = op == "hide"
    docs = {k: [plain_words(f) for f in r["fields"]] for k, r in state.items() if not r["hidden"] and not r["deleted"]}
    tokens = []
    for t in re.findall(r"[A-Za-z0-9_@#./:-]{2,}", query)[:24]:
        if t.lower() not in [u.lower() for u in tokens]:
            tokens.append(t)
    phrases = [p for p in map(plain_words, tokens) if p]

    def often(words, phrase):
        n = at = 0
        while at + len(phrase) <= len(words):
            hit = words[at : at + len(phrase)] == phrase
            n, at = n + hit, at + (len(phrase) if hit else 1)
        return n

    length = {k: sum(map(len, f)) for k, f in docs.items()}
    mean, scores = sum(length.values()) / max(1, len(docs)), {}
    for p in phrases:
        tf = {k: sum(often(f[i], p) for i in fields) for k, f in docs.items()}
        df = sum(v > 0 for v in tf.values())
        idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
        for k, v in tf.items():
            if v:
                scores[k] = scores.get(k, 0) + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * length[k] / mean))
    return {k: pytest.approx(v, abs=2e-6) for k, v in scores.items()}


def found(spark, path, query, **more):
    return {r["key"]: r["score"] for r in fulltext.search(spark, path, query, 1000, **more).collect()}


QUERIES = ["auth lunch", "cafe naive the", "fix-me", "zoe bob png", "x2 the-auth"]


def test_search_after_any_changes_and_merges_equals_a_fresh_build(spark, tmp_path):
    """Batches cut at random; after each, every search equals that over the state of all events so far."""
    rng = random.Random(4)
    events = drawn_events(rng, 160, 25)
    cuts = sorted(rng.sample(range(1, 160), 4))
    path, runs = f"{tmp_path}/i", Runs(spark, f"{tmp_path}/i")
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 160])):
        batch = events[a:b] + events[max(0, a - 5) : a]  # a few come twice
        fulltext.apply_changes(spark.createDataFrame(batch, EVENTS), path, i)
        if i == 2:
            fulltext.merge(spark, path, runs.live()[1:])
            assert [(r.start, r.upto) for r in runs.live()] == [(-1, 0), (0, 2)]
        for q in QUERIES[:2] if i < 4 else QUERIES:
            assert found(spark, path, q) == slow_search(events[:b], q)
    assert found(spark, path, "lunch", fields=["attachment_summary"]) == slow_search(events, "lunch", [2])
    before = current_index(spark, path).orderBy("message_id").collect()
    fulltext.merge(spark, path)
    assert len(runs.live()) == 1 and fulltext.index_size(spark, path).first()["gone"] == 0
    assert all(found(spark, path, q) == slow_search(events, q) for q in QUERIES)
    assert current_index(spark, path).orderBy("message_id").collect() == before
    assert runs.sweep(fulltext.TABLES) > 0 and found(spark, path, "auth") == slow_search(events, "auth")


def test_scripts_and_marks(spark, tmp_path):
    texts = {1: "Café naïve", 2: "Привет мир", 3: "世界 hello", 4: "cafe\u0301", 5: "caf e"}
    rows = [(k, "upsert", k, t, None, None) for k, t in texts.items()]
    fulltext.apply_changes(spark.createDataFrame(rows, EVENTS), f"{tmp_path}/i", 0)
    terms = {r["term"] for r in Runs(spark, f"{tmp_path}/i").read("postings", fulltext.POSTINGS, Runs(spark, f"{tmp_path}/i").live()).collect()}
    assert terms == {"cafe", "naive", "привет", "мир", "世界", "hello", "caf", "e"}
    assert set(found(spark, f"{tmp_path}/i", "cafe")) == {1, 4} and set(found(spark, f"{tmp_path}/i", "caf")) == {5}


def test_a_failure_between_writes_leaves_the_last_state(spark, tmp_path, monkeypatch):
    """Neither a batch nor a merge that breaks before its commit is seen; when it is run again, it replaces what it left."""
    path, events = f"{tmp_path}/i", drawn_events(random.Random(9), 60, 9)
    frames = [spark.createDataFrame(events[i : i + 20], EVENTS) for i in (0, 20, 40)]
    fulltext.apply_changes(frames[0], path, 0)
    real = Runs.write

    def broken(after):
        calls = iter(range(100))

        def write(self, *rest, **more):
            if next(calls) >= after:
                raise OSError("disk full")
            return real(self, *rest, **more)

        return write

    for after in range(4):
        monkeypatch.setattr(Runs, "write", broken(after))
        with pytest.raises(OSError):
            fulltext.apply_changes(frames[1], path, 1)
        monkeypatch.setattr(Runs, "write", real)
        assert found(spark, path, "auth lunch") == slow_search(events[:20], "auth lunch")
    fulltext.apply_changes(frames[1], path, 1)
    fulltext.apply_changes(frames[1], path, 1)  # a second time: known by its number
    fulltext.apply_changes(frames[2], path, 2)
    monkeypatch.setattr(Runs, "write", broken(2))
    with pytest.raises(OSError):
        fulltext.merge(spark, path)
    monkeypatch.setattr(Runs, "write", real)
    assert len(Runs(spark, path).live()) == 3 and found(spark, path, "auth lunch") == slow_search(events, "auth lunch")


def test_runs_of_one_size_are_merged_as_they_come(spark, tmp_path):
    runs = Runs(spark, f"{tmp_path}/r")
    for i in range(20):
        runs.commit(Run(i - 1, i))
        crowd = runs.crowded(4)
        if crowd:
            runs.commit(Run(crowd[0].start, crowd[-1].upto))
    live = runs.live()
    assert live[0].start == -1 and live[-1].upto == 19 and all(a.upto == b.start for a, b in zip(live, live[1:])) and len(live) <= 8


def test_streaming_limiter_admits_as_the_batch_one(spark, tmp_path):
    rows = [(i % 3, i, T0 + timedelta(seconds=7 * i)) for i in range(90)]
    frame = spark.createDataFrame(rows, "user long, id long, ts timestamp")
    for part in range(3):
        frame.where(f"id div 30 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    rules = [(60, 2), (600, 8)]
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    query = admit_stream(stream, "user", "ts", "id", rules).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["id"]: (r["accepted"], r["retry_after"]) for r in spark.table("admitted").collect()}
    want = {r["id"]: (r["accepted"], r["retry_after"]) for r in limits.admitted(frame, "user", "ts", "id", rules).collect()}
    assert got == want and {a for a, _ in got.values()} == {True, False}


def test_windowed_counts_match_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/src")
    query = windowed_counts(stream, "ts", "event_type", "1 day", "1 hour").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r["n"] for r in spark.table("counts").collect()) == events.count()


def test_text_index_follows_the_stream(spark, tmp_path):
    src, index = f"{tmp_path}/src", f"{tmp_path}/index"
    schema = "seq long, op string, message_id long, content string, ts timestamp"

    def more(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        maintain_index(change_log(spark, src), index, f"{tmp_path}/c1").awaitTermination()

    def best(query):
        return [r["key"] for r in fulltext.search(spark, index, query, 10).collect()]

    more([(1, "upsert", 1, "fix the auth module", T0), (2, "upsert", 2, "auth auth auth", T0), (3, "upsert", 3, "lunch", T0), (4, "upsert", 4, " ", T0)])
    assert best("auth") == [2, 1] and best("lunch") == [3] and best("the-auth") == [1]
    more([(5, "upsert", 2, "now about lunch", T0), (6, "hide", 3, None, T0)])
    assert best("auth") == [1] and best("lunch") == [2]
    more([(7, "delete", 1, None, T0)])
    assert best("auth") == [] and best("?!") == []
    compact(spark, index)
    assert current_index(spark, index).count() == 3 and best("lunch") == [2]


def test_phrases_by_places(spark, tmp_path):
    texts = {1: "a-b a-b-a-b", 2: "a b", 3: "b a", 4: "x x x x x", 6: "a, B!"}
    fulltext.apply_changes(spark.createDataFrame([(k, "upsert", k, t, None, None) for k, t in texts.items()], EVENTS), f"{tmp_path}/i", 0)
    hits = lambda q: set(found(spark, f"{tmp_path}/i", q))
    assert hits("a-b") == {1, 2, 6} and hits("b-a") == {1, 3} and hits("x-x") == {4} and hits("x-x-x-x-x-x") == set()
    docs = spark.createDataFrame(list(texts.items()), "id long, t string")
    for q in ("a-b", "b-a", "x-x bb", "aa a-b xx"):
        assert [tuple(r) for r in fulltext.search(spark, f"{tmp_path}/i", q, 10).collect()] == [tuple(r) for r in bm25(docs, "id", "t", q, 10).collect()]


def test_live_batches_reply_once_to_each_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"m{i}") for i in range(6)], "id long, text string")
    for part in range(2):
        rows.where(f"id % 2 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    seen = {}
    query = live_batches(stream, lambda b, i: seen.setdefault(i, sorted(r["id"] for r in b.collect())), f"{tmp_path}/c", 1)
    try:
        for _ in range(60):
            if sum(map(len, seen.values())) == 6:
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert sorted(x for v in seen.values() for x in v) == list(range(6)) and len([v for v in seen.values() if v]) == 2
