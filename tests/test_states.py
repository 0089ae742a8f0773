"""Streams with timers: states of vectors, and live channels."""

import random
import time
from datetime import datetime, timedelta

import pytest

from palaver.operators import changes
from palaver.streaming import live, vectors

T0 = datetime(2024, 5, 1, 12)


def drawn(rng, n, keys):
    out, at = [], T0
    for seq in range(1, n + 1):
        at += timedelta(seconds=rng.randrange(200))
        op = rng.choice(["content", "content", "ok", "fail", "fail", "fail"])
        out.append((seq, op, rng.randrange(keys), rng.choice("abc") if op != "fail" else None, at, rng.choice([None, "no vector", "x" * 600]) if op == "fail" else None))
    return out


SCHEMA = "seq long, op string, message_id long, hash string, at timestamp, error string"


def through(spark, tmp_path, batches, name, **more):
    """The rows that a stream of these batches gives, each a micro-batch of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/src/b{i}")
        time.sleep(0.02)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/src")
    query = vectors.vector_states(stream, **more).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_states_equals_the_batch_after_any_cut(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = drawn(rng, 220, 12)
    cuts = [0, *sorted(rng.sample(range(1, 220), 3)), 220]
    # a few events come again in the next batch
    rows = through(spark, tmp_path, [events[max(0, a - 4) : b] for a, b in zip(cuts, cuts[1:])], f"states{seed}", late="100 days")
    last = {}
    for r in rows:
        if r["kind"] == "state" and (r["message_id"] not in last or last[r["message_id"]]["seq"] < r["seq"]):
            last[r["message_id"]] = r
    columns = ["message_id", "hash", "status", "attempts", "next_retry_at", "last_error"]
    want = changes.embedding_state(spark.createDataFrame(events, SCHEMA)).collect()
    assert sorted(tuple(r[c] for c in columns) for r in last.values()) == sorted(tuple(r[c] for c in columns) for r in want)


def test_a_message_is_due_when_its_wait_is_over(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [(1, "content", 1, "a", at(0), None), (2, "fail", 1, None, at(1), "no vector"), (3, "content", 2, "b", at(2), None), (4, "fail", 2, None, at(3), None)],
        [(5, "ok", 2, "b", at(40), None), (6, "ok", 3, "z", at(55), None)],  # 2 has its vector before it is due; one for unknown content
        [(7, "content", 4, "c", at(200), None)],  # the watermark passes what 1 waits for
        [(8, "content", 4, "c", at(205), None)],  # timers come after a batch's rows
        [(9, "fail", 1, None, at(210), "again"), (10, "fail", 1, None, at(212), "at last")],
        [(11, "content", 4, "d", at(5000), None)],
    ]
    rows = through(spark, tmp_path, batches, "due", late="1 second", keep_seconds=3000)
    due = [(r["message_id"], r["attempts"], r["next_retry_at"]) for r in rows if r["kind"] == "due"]
    assert due == [(1, 1, at(61))]
    states = [(r["message_id"], r["status"], r["attempts"]) for r in rows if r["kind"] == "state"]
    assert (2, "done", 0) in states and (1, "failed", 3) in states and not any(m == 3 for m, _, _ in states)


def test_what_is_done_is_forgotten_after_its_keeping(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [[(1, "content", 1, "a", at(0), None), (2, "ok", 1, "a", at(1), None)], [(3, "content", 9, "x", at(100), None)], [(4, "content", 9, "y", at(200), None)], [(5, "content", 1, "a", at(201), None)]]
    rows = through(spark, tmp_path, batches, "kept", late="1 second", keep_seconds=60)
    assert [(r["status"], r["seq"]) for r in rows if r["message_id"] == 1] == [("done", 2), ("pending", 5)]


def test_stale_vectors_and_repeated_events():
    state = vectors.advanced(None, [(1, "content", "a", 0, None), (2, "content", "b", 1, None), (3, "ok", "a", 2, None)])
    assert not state["done"] and vectors.advanced(state, [(3, "ok", "b", 2, None)]) == state
    assert vectors.advanced(state, [(4, "ok", "b", 3, None)])["done"]


def test_queue_after_the_worker():
    """At once when idle, together after the pause, nothing when switched off."""
    q = live.Queue(1000, True, 0, None, [])
    said = lambda *ids: [("message", (i, 1, f"m{i}")) for i in ids]
    assert q.arrived(said(1, 2), 0) == (1, [(1, 1, "m1"), (2, 1, "m2")]) and q.pause_ends == 1000
    assert q.arrived(said(3), 100) is None and q.arrived(said(4), 900) is None
    assert q.rested(1000)[1] == [(3, 1, "m3"), (4, 1, "m4")] and q.pause_ends == 2000
    assert q.rested(2000) is None and q.pause_ends is None
    assert q.arrived(said(5), 5000)[0] == 3
    assert q.arrived([*said(6), ("setting", False), *said(7)], 5100) is None and q.rested(6000) is None
    assert q.arrived(said(8), 7000) is None and q.arrived([("setting", True), *said(9)], 8000) == (4, [(9, 1, "m9")])


def test_live_channels_as_a_stream(spark, tmp_path):
    schema = "channel_id long, message_id long, author_id long, content string, at timestamp"

    def say(*rows):
        spark.createDataFrame([(c, m, 1, f"m{m}", T0 + timedelta(seconds=m)) for c, m in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/said")

    def switch(channel, on, second):
        spark.createDataFrame([(channel, on, T0 + timedelta(seconds=second))], "channel_id long, enabled boolean, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/set")

    switch(1, True, 0)
    switch(2, True, 0)
    say((1, 1), (1, 2), (2, 3), (3, 4))  # channel 3 isn't live
    stream = live.live_queues(spark.readStream.schema(schema).parquet(f"{tmp_path}/said"), spark.readStream.schema("channel_id long, enabled boolean, at timestamp").parquet(f"{tmp_path}/set"), 20.0)
    query = stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()

    def batches():
        return {(r["channel_id"], r["number"]): [m["message_id"] for m in r["messages"]] for r in spark.table("live").collect()}

    def wait(n):
        for _ in range(180):
            if len(batches()) >= n:
                break
            query.awaitTermination(0.5)
        return batches()

    try:
        first = {(1, 1): [1, 2], (2, 1): [3]}
        assert wait(2) == first
        say((1, 5), (2, 6))
        say((1, 7))
        switch(2, False, 10)
        assert wait(3) == {**first, (1, 2): [5, 7]}  # channel 2 lost what waited
    finally:
        query.stop()
