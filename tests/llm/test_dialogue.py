"""Operator 12 against a brute-force version that compares whole strings of edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from palaver.llm import dialogue as D
from palaver.llm.queries import ORACLE_SQL, op12_conversations


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        out += [(conv, turn, "user" if deal == 4 else role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    return out


def slow_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        shown = re.sub("[\x20\x09-\x0d]+$", "", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    # cheapest (cost, letters, lines) from a row on by the initial of the row before, '' at the beginning
    states = ["", "s", "u", "a"]
    value = {}
    for i in range(len(rows), -1, -1):
        now = {}
        for last in states:
            options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
            if i < len(rows):
                _, role, text = rows[i]
                cost, letters, lines = value[i + 1][last]
                options.append((cost + 3, "D" + letters, lines))
                if faults[i] in ("", "truncated"):
                    more = int(faults[i] == "truncated")
                    for letter, new, price in (("K", role, 0), ("R", "assistant" if last == "u" else "user", 2)):
                        x = new[:1]
                        if (x == "s" and last == "") or (x == "u" and last != "u") or (x == "a" and last == "u"):
                            cost, letters, lines = value[i + 1][x]
                            options.append((cost + price + more, letter + letters, (f"{new}:{text}", *lines)))
            now[last] = min(options, default=(10**9, "", ()))
        for _ in range(4):
            for last in states:
                new = "assistant" if last == "u" else "user"
                cost, letters, lines = now[new[0]]
                now[last] = min(now[last], (cost + 2, "I" + letters, (f"{new}:", *lines)))
        value[i] = now
    cost, audit, lines = value[0][""]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow(rows):
    """The query's rows, as sorted tuples."""
    held = defaultdict(list)
    for conv, turn, role, text in slow_damage(rows):
        held[conv].append((turn, role, text))
    return sorted(((conv, *slow_repair(held[conv])) for conv in {r[0] for r in rows}), key=str)


def drawn(rng, conv, n):
    texts = ["one thing.", "another!", "cut of", "", " \t\n", "why?", "ends so. \n", "é?", "世界"]
    return [(conv, rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice([*texts, f"{rng.random()}.", None])) for _ in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_query_equals_brute_force(spark, tmp_path, coalesced):
    """With adaptive coalescing off the few rows lie in eight partitions, which most conversations share."""
    rng = random.Random(7)
    rows = [r for c in [None, *range(120)] for r in drawn(rng, c, rng.randrange(1, 30))]
    rows += rows[:40]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        got = sorted(map(tuple, op12_conversations(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == slow(rows)


def test_one_conversation_of_most_rows_is_several_partitions(spark, monkeypatch):
    """A hot conversation, a hot row of it and a hot text of it; letters are put together from many blocks."""
    monkeypatch.setattr(D, "BLOCK_BITS", 5)
    rng = random.Random(1)
    rows = drawn(rng, 1, 3000) + [(1, 5, "user", "the same.")] * 1500 + [(1, t, "assistant", "the same.") for t in range(900)] + drawn(rng, 2, 40) + drawn(rng, 3, 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = D.damaged(spark.createDataFrame(rows, SCHEMA).repartition(6))
        got = sorted(map(tuple, D.repair_conversations(frame).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == slow(rows)


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    frame = op12_conversations(spark, sf_dir)
    cursor = con.execute(ORACLE_SQL["op12_conversations"])
    assert [d[0] for d in cursor.description] == frame.columns
    assert sorted(map(tuple, frame.collect())) == sorted(cursor.fetchall())


def test_few_vectors_are_states_however_long_the_conversation():
    tool, rng = D.Repairer(), random.Random(2)
    tool.repair("".join(rng.choice(D.LETTERS) for _ in range(200_000)))
    assert len(tool.vectors) < 200 and tool.repair("") == (0, [""])


def test_odd_tables(spark):
    assert D.repair_conversations(D.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    nothing = hashlib.sha256(b"").hexdigest()
    gone = spark.createDataFrame([(4, 1, "user", "x.", True, "extra"), (None, None, None, None, True, "extra")], SCHEMA + ", gone boolean, cost string")
    assert sorted(map(tuple, D.repair_conversations(gone).collect()), key=str) == [(4, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)]
    long = "word " * 300_000 + "end."
    row = D.repair_conversations(spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", " " * 1_000_000 + "a.")], SCHEMA)).first()
    assert row["audit"] == "KK" and row["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{' ' * 1_000_000}a.".encode()).hexdigest()
