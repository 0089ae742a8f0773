"""Scans over large groups against loops, with one channel of nearly all rows and chunks of few."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from palaver.operators import changes, limits, scans

T0 = datetime(2024, 5, 1, 12)
SCHEMA = "channel long, id long, at timestamp, n long"


def drawn(seed, n=1500):
    """Rows of which nine in ten are of one channel; many share their time, some have neither channel nor time."""
    rng, out = random.Random(seed), []
    for i in range(n):
        channel = 1 if rng.random() < 0.9 else rng.choice([2, 3, None])
        out.append((channel, i, T0 + timedelta(seconds=rng.choice([rng.randrange(500), rng.randrange(40_000)])), rng.randrange(9)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return drawn(request.param)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return {k: sorted(v, key=lambda r: (r[2], r[1])) for k, v in out.items()}


ORDER = ["at", "id"]


@pytest.mark.parametrize("most", [40, 10_000])
def test_numbers(frame, rows, most):
    want = {r[1]: i for g in groups(rows).values() for i, r in enumerate(g, 1)}
    assert {r["id"]: r["rn"] for r in scans.numbered(frame, ["channel"], ORDER, most=most).collect()} == want
    every = {r[1]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1)}
    assert {r["id"]: r["rn"] for r in scans.numbered(frame, [], ORDER, most=most).collect()} == every


@pytest.mark.parametrize("most", [40, 10_000])
@pytest.mark.parametrize("gap", [0, 30, 400])
def test_sessions(frame, rows, most, gap):
    want = {}
    for g in groups(rows).values():
        session, last = 0, None
        for r in g:
            session += last is None or (r[2] - last).total_seconds() > gap
            want[r[1]], last = session, r[2]
    assert {r["id"]: r["session"] for r in scans.sessions(frame, ["channel"], "at", "id", gap, most=most).collect()} == want


@pytest.mark.parametrize("most", [40, 10_000])
@pytest.mark.parametrize("seconds", [0, 20, 9000])
def test_counts_of_a_sliding_window(frame, rows, most, seconds):
    want = {}
    for g in groups(rows).values():
        for r in g:
            want[r[1]] = sum(r[2] - timedelta(seconds=seconds) <= x[2] <= r[2] for x in g)
    assert {r["id"]: r["n_in"] for r in scans.within(frame, ["channel"], "at", seconds, "n_in", most=most).collect()} == want


@pytest.mark.parametrize(("most", "size"), [(40, 1), (40, 12), (40, 150), (10_000, 12)])
def test_rolling_lists(frame, rows, most, size):
    """150 is longer than a chunk: a row is lent to several."""
    want = {r[1]: [x[3] for x in g[max(0, i - size + 1) : i + 1]] for g in groups(rows).values() for i, r in enumerate(g)}
    assert {r["id"]: r["last"] for r in scans.rolling(frame, ["channel"], ORDER, "n", size, "last", most=most).collect()} == want


def test_chunks_of_a_hot_channel_are_even(frame, rows):
    large = scans.dealt(frame, ["channel"], ORDER, 100).large
    sizes = Counter(r["_chunk"] for r in large.select("_chunk").collect())
    assert len(sizes) > 8 and max(sizes.values()) < 3 * 100


def test_equal_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(1, 1, T0, 0)] * 200, SCHEMA)
    assert sorted(r["rn"] for r in scans.numbered(same, ["channel"], ORDER, most=10).collect()) == list(range(1, 201))
    assert {r["c"] for r in scans.within(same, ["channel"], "at", 5, "c", most=10).collect()} == {200}
    none = same.limit(0)
    assert scans.numbered(none, [], ORDER).count() == scans.sessions(none, ["channel"], "at", "id", 5).count() == scans.rolling(none, ["channel"], ORDER, "n", 3, "l").count() == 0


def test_limiter_of_a_heavy_user_by_stretches(spark):
    """One user of nearly all requests, in bursts with pauses; the stretches lie in many tasks."""
    rng, rows, t = random.Random(3), [], 0
    for i in range(6000):
        t += rng.choice([1, 2, 5, 5, 30]) if rng.random() > 0.01 else 601
        rows.append((1 if rng.random() < 0.95 else rng.choice([2, None]), i, T0 + timedelta(seconds=t)))
    frame = spark.createDataFrame(rows, "user long, id long, ts timestamp").repartition(4)
    rules = [(60, 4), (600, 15)]
    get = lambda most: {r["id"]: (r["accepted"], r["retry_after"]) for r in limits.admitted(frame, "user", "ts", "id", rules, most=most).collect()}
    want = {}
    for user in (1, 2, None):
        window = limits.Accepted(rules)
        for _, i, ts in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            wait = window.wait(int((ts - T0).total_seconds() * 1_000_000))
            want[i] = (wait == 0, wait or None)
    assert get(100) == get(10**6) == want


def test_reports_of_one_day_are_numbered_without_gaps(spark, monkeypatch):
    drafts = [(i % 7, "bob", "issue", f"text {i % 50}", T0 + timedelta(seconds=i % 90)) for i in range(600)]
    frame = spark.createDataFrame(drafts, "reporter_id long, reporter_name string, report_type string, description string, at timestamp")
    whole = [tuple(r) for r in changes.new_reports(frame, 5).orderBy("id").collect()]
    real = scans.dealt
    monkeypatch.setattr(scans, "dealt", lambda rows, by, order, most=0: real(rows, by, order, 50))
    assert [tuple(r) for r in changes.new_reports(frame, 5).orderBy("id").collect()] == whole and [r[0] for r in whole] == list(range(6, 606))


def test_rows_without_a_time_are_alike_in_large_and_small_groups(spark, rows):
    odd = [(c, i, None if i % 6 == 0 else t, n) for c, i, t, n in rows[:600]]
    frame = spark.createDataFrame(odd, SCHEMA).repartition(3)
    for scan in (
        lambda most: scans.numbered(frame, ["channel"], ORDER, "v", most), lambda most: scans.sessions(frame, ["channel"], "at", "id", 60, "v", most),
        lambda most: scans.within(frame, ["channel"], "at", 900, "v", most), lambda most: scans.rolling(frame, ["channel"], ORDER, "n", 7, "v", most),
    ):
        small, large = ({r["id"]: r["v"] for r in scan(most).collect()} for most in (10_000, 30))
        assert small == large and len(small) == len(odd)
