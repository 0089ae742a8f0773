"""Cases that the tables don't hold."""

import difflib
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as X
from palaver.operators import changes, limits, markup, messages, retrieval, suggestions, windows
from palaver.sources import sinks, tables

T0 = datetime(2024, 5, 1, 12)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_message_log_rules(spark):
    log = [
        (1, "hide", 9, None), (2, "upsert", 9, "before"), (3, "upsert", 1, " a  b "), (4, "hide", 1, None), (5, "upsert", 1, "new text"),
        (6, "upsert", 2, "x"), (7, "delete", 2, None), (8, "upsert", 2, "back?"), (9, "upsert", 3, "  "), (10, "delete", 4, None), (11, "upsert", 4, "kept"),
        (12, "upsert", 5, "y"), (13, "hide", 5, None), (14, "unhide", 5, None),
    ]
    rows = {r["message_id"]: r for r in changes.message_state(spark.createDataFrame(log, "seq long, op string, message_id long, content string")).collect()}
    assert set(rows) == {9, 1, 2, 4, 5}
    assert [(rows[i]["hidden"], rows[i]["deleted"]) for i in (9, 1, 2, 4, 5)] == [(False, False), (True, False), (True, True), (False, False), (False, False)]
    assert rows[1]["content_text"] == "new text"


def slow_embedding(events):
    state = None
    for op, h in events:
        if op == "content" and (state is None or state[0] != h):
            state = (h, "pending", 0)
        elif op == "ok" and state and state[0] == h:
            state = (h, "done", 0)
        elif op == "fail" and state:
            state = (state[0], "failed" if state[2] + 1 >= 3 else "pending", state[2] + 1)
    return state


def test_embedding_fold_against_a_loop(spark):
    rng = random.Random(6)
    logs = {k: [(rng.choice(["content", "ok", "fail", "fail"]), rng.choice("ab")) for _ in range(rng.randint(1, 9))] for k in range(200)}
    rows = [(i, op, k, h) for k, v in logs.items() for i, (op, h) in enumerate(v)]
    rng.shuffle(rows)
    log = spark.createDataFrame([(*r, T0 + timedelta(hours=r[0]), None) for r in rows], "seq long, op string, message_id long, hash string, at timestamp, error string")
    found = changes.embedding_state(log).collect()
    assert {r["message_id"]: (r["hash"], r["status"], r["attempts"]) for r in found} == {k: s for k, v in logs.items() if (s := slow_embedding(v))}
    for r in found:
        failed = [i for i, (op, _) in enumerate(logs[r["message_id"]]) if op == "fail"]
        waits = r["status"] == "pending" and r["attempts"] > 0
        assert r["next_retry_at"] == (T0 + timedelta(hours=failed[-1], seconds=60 * 2 ** (r["attempts"] - 1)) if waits else None)
        assert r["last_error"] == ("embedding failed" if r["attempts"] else None)


def test_limiter_against_a_loop(spark):
    rng = random.Random(2)
    rows, at = [], {u: T0 for u in range(5)}
    for i in range(600):
        u = rng.randrange(5)
        at[u] += timedelta(seconds=rng.choice([0, 1, 3, 6, 60]))
        rows.append((u, i, at[u]))
    rules = [(60, 5), (600, 20)]
    kept, want = {}, {}
    for u, i, t in rows:
        own = kept.setdefault(u, [])
        want[i] = all(sum(x >= t - timedelta(seconds=s) for x in own) < n for s, n in rules)
        if want[i]:
            own.append(t)
    got = limits.admitted(spark.createDataFrame(rows, "user long, id long, ts timestamp"), "user", "ts", "id", rules).collect()
    assert {r["id"]: r["accepted"] for r in got} == want


def test_session_gap_of_exactly_a_day_holds_together(spark):
    day = timedelta(hours=24)
    rows = [(1, 1, T0), (1, 2, T0 + day), (1, 3, T0 + 2 * day + timedelta(seconds=1))]
    frame = spark.createDataFrame(rows, "c long, id long, ts timestamp")
    assert [r["session"] for r in windows.sessions(frame, ["c"], "ts", 86_400, "id").orderBy("id").collect()] == [1, 1, 2]
    assert [r["id"] for r in windows.session_tail(frame, ["c"], "ts", "id").collect()] == [3]


def test_bm25_exact_terms_and_phrases(spark):
    docs = spark.createDataFrame([(101, "The build failed with TokenMismatchError in auth.py"), (102, "Unrelated weekend planning"), (103, "py auth")], "id long, text string")
    assert [r["id"] for r in retrieval.bm25(docs, "id", "text", "TokenMismatchError auth.py", 5).collect()] == [101]
    assert retrieval.bm25(docs, "id", "text", "日本", 5).count() == 0


def test_cosine_order_and_odd_vectors(spark):
    frame = spark.createDataFrame([(201, [1.0, 0.0, 0.0]), (202, [0.0, 1.0, 0.0]), (203, [0.0, 0.0, 0.0]), (204, [1.0]), (205, [])], "id long, v array<double>")
    assert [r["id"] for r in retrieval.nearest(frame, "id", "v", [0.9, 0.1, 0.0], 5).collect()] == [201, 202]


def test_pack_takes_pins_first_and_keeps_the_order(spark):
    pins, found = spark.createDataFrame([(900, 1)], "id long, pos long"), spark.createDataFrame([(401, 1), (402, 2)], "id long, pos long")
    assert [(r["id"], r["part"]) for r in retrieval.pack(pins, found, "id", "pos", 2).orderBy("slot").collect()] == [(900, "pin"), (401, "retrieved")]


def test_scope_visibility_and_exclusion(spark):
    rows = spark.createDataFrame([(1, 10, 20, False, None), (2, 10, 21, False, None), (3, 11, 20, True, None), (4, 10, 20, False, T0)], "id long, guild_id long, channel_id long, hidden boolean, deleted_at timestamp")
    ids = lambda f: sorted(r["id"] for r in f.collect())
    assert ids(messages.in_scope(rows, 10, 20, True)) == [1, 2, 4] and ids(messages.in_scope(rows, None, 20, True)) == [1, 3, 4]
    assert ids(messages.visible(rows)) == [1, 2] and ids(messages.excluding(rows, [1, 2], "id")) == [3, 4] and ids(messages.excluding(rows, [], "id")) == [1, 2, 3, 4]
    assert ids(messages.excluding(rows, list(range(2, 1000)), "id")) == [1]


def test_status_updates(spark):
    reports = spark.createDataFrame([(1, "open", None), (2, "open", "old")], "id long, status string, admin_notes string")
    updates = spark.createDataFrame([(1, 1, " In_Progress ", " seen "), (1, 2, "done", None), (7, 1, "done", None)], "id long, seq long, status string, notes string")
    assert sorted(map(tuple, changes.report_state(reports, updates).collect())) == [(1, "done", "seen"), (2, "open", "old")]
    with pytest.raises(Exception, match="unknown report status"):
        changes.report_state(reports, spark.createDataFrame([(1, 1, "nonsense", "")], "id long, seq long, status string, notes string")).collect()


def test_splits_lose_nothing():
    text = "```\n" + "x" * 5000 + "\n```"
    assert "".join(markup.split_text(text, 2000)) == text and all(len(p) <= 2000 for p in markup.split_text(text, 2000))
    words = " ".join(f"word{i}." for i in range(900))
    parts = markup.split_text(words, 500)
    bare = [p.split("*\n\n")[-1] if i else p for i, p in enumerate(parts)]
    assert "".join(p.split("\n\n*(")[0] for p in bare) == words and all(len(p) <= 500 for p in parts)
    assert markup.split_text("", 10) == [""] and markup.split_text("   ", 10) == ["   "]


def test_blocks_latex_and_tables(spark):
    assert [b[2] for b in markup.blocks_of("# head\n**b** `c` ```py\n**no**``` [l](u)\n- item")] == ["header", "bold", "inline_code", "code_block", "link", "unordered_item"]
    plain = lambda e: value(spark, markup.plain_latex(F.lit(e)))
    assert plain(r"\alpha^2 + x_{10} \frac{a}{b}") == "α² + x₁₀ (a)/(b)" and plain(r"\unknown x") is None and plain("") == ""
    assert plain(r"\frac{a_{1}}{x^{-2}} \cdots") == "(a₁)/(x⁻²) ·s"
    table = lambda t: value(spark, markup.table_block(F.lit(t)))
    assert table("| Name | V |\n|---|---|\n| foo | bar |") == "```\nName | V  \n-----+----\nfoo  | bar\n```"
    assert table("one line") == "one line" and table("|--|\n|--|") == "|--|\n|--|"


def test_raw_latex_is_wrapped():
    assert markup.wrapped_latex(r"so: \sqrt{2} = x") == r"so: $$\sqrt{2} = x$$"
    assert markup.wrapped_latex(r"\frac{1}{2}") == r"$$\frac{1}{2}$$" and markup.wrapped_latex(r"has $\frac{1}{2}$") == r"has $\frac{1}{2}$"
    assert markup.wrapped_latex(r"use `\frac{1}{2}` and `code`") == r"use $$\frac{1}{2}$$ and `code`"
    assert markup.wrapped_latex("```\n\\frac{1}{2}\n```") == "```\n\\frac{1}{2}\n```"
    assert markup.wrapped_latex(r"\begin{aligned}a &= b \\ c \text{if {x}} d\end{aligned}") == "$$a  = b$$\n$$c$$ if {x} $$d$$"


def slow_points(text, most):
    out, last = [], 0
    for at in range(1, len(text) + 1):
        end = text[at - 1] == "\n" or (text[at - 1].isspace() and any(text[k] in ".!?" and text[k + 1 : at].isspace() for k in range(at - 1)) and (at == len(text) or not text[at].isspace()))
        inside = any(a < at < b for a, b, k in markup.blocks_of(text) if k in markup.INLINE or k == "code_block")
        if end and not inside and at - last >= most / 2:
            out.append(at)
            last = at
    return out


def test_safe_points_and_context(spark):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "end. ", "line\n", "**bold. x** ", "`co. de` ", "```\na. b\nc\n``` ", "x"]) for _ in range(rng.randint(0, 30)))
        got = markup.safe_points(text, 40)
        # a line end before others may be skipped by the slow way where a run of spaces goes on
        assert got == slow_points(text, 40)
        assert all(b - a >= 20 for a, b in zip([0, *got], got, strict=False))
    rows = spark.createDataFrame([(1, "a **b** c", 4), (2, "```x```", 3), (3, "- item", 3), (4, "plain", 2)], "id int, t string, at int")
    got = {r["id"]: (r["in_code_block"], r["in_list"], r["active"]) for r in markup.markdown_context(rows, "id", "t", "at").collect()}
    assert got == {1: (False, False, "bold"), 2: (True, False, ""), 3: (False, True, ""), 4: (False, False, "")}


def test_suggestions_and_help(spark):
    typed = spark.createDataFrame([("lyve",), ("pins please",), ("zzz",)], "typed string")
    known = spark.createDataFrame([("live",), ("pins",), ("stats",)], "command string")
    assert sorted((r["typed"], r["command"]) for r in suggestions.suggest(typed, known).collect()) == [("lyve", "live"), ("pins please", "pins")]
    got = {r["typed"]: (r["command"], r["confidence"]) for r in suggestions.suggest(typed, known, typos={"zzz": "stats"}).where("rank = 1").collect()}
    assert got["lyve"] == ("live", 0.75) and got["pins please"][0] == "pins" and got["zzz"] == ("stats", 0.95)
    sections = spark.createDataFrame([("Pins", ["pin"], "keep a message", ["/pin hello"]), ("Images", ["image"], "edit an image", [])], "title string, keywords array<string>, content string, examples array<string>")
    rows = suggestions.help_scores(spark.createDataFrame([("how do i pin a message",)], "query string"), sections).collect()
    assert [(r["title"], r["score"]) for r in rows if r["rank"] == 1] == [("Pins", 3.0)]


def slow_suggestions(typed, commands, least, most):
    out = []
    for t in set(typed):
        low, found = t.lower().strip(), []
        for command in set(commands):
            c = command.lower()
            words, own = set(low.split()), set(c.split())
            shared = len(words & own) / max(len(words), len(own), 1)
            confidence = max(0.8 if low in c or c in low else 0.0, shared * 0.7, difflib.SequenceMatcher(None, low, c).ratio())
            if confidence >= least:
                found.append((-confidence, command))
        out += [(t, c, pytest.approx(-s, abs=2e-6), i) for i, (s, c) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize("least", [0.7, 0.4])
def test_suggestions_from_long_lists_in_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(suggestions, "LEFT_ROWS", 7)
    monkeypatch.setattr(suggestions, "RIGHT_ROWS", 300)
    rng = random.Random(5)
    words = ["pin", "pins", "live", "Stats", "report", "help me", "usage", "é", "reset all", "set"]
    commands = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(12))) for _ in range(1500)] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    typed = [c[: rng.randrange(len(c) + 1)] + rng.choice(["", "x", " a"]) for c in rng.sample(commands, 25)] + ["", " ", "PIN", "x" * 300]
    got = suggestions.suggest(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(c,) for c in commands], "command string"), least)
    assert sorted((tuple(r) for r in got.select("typed", "command", "confidence", "rank").collect()), key=lambda r: (r[0], r[3])) == slow_suggestions(typed, commands, least, 5)


def test_help_of_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suggestions, "LEFT_ROWS", 9)
    monkeypatch.setattr(suggestions, "RIGHT_ROWS", 40)
    rng = random.Random(6)
    words = ["pin", "pins", "a", "message", "Live", "mode", "image", "edit", ""]
    some = lambda n: [rng.choice(words) for _ in range(rng.randrange(n))]
    sections = [(f"{' '.join(some(3))} {i}", some(4), rng.choice([" ".join(some(6)), None]), [" ".join(some(3)) for _ in range(rng.randrange(3))]) for i in range(150)]
    queries = list({" ".join(some(7)) for _ in range(30)} | {"", "PINS Mode"})
    frame = spark.createDataFrame(sections, "title string, keywords array<string>, content string, examples array<string>")
    got = {(r["query"], r["title"]): r["score"] for r in suggestions.help_scores(spark.createDataFrame([(q,) for q in queries], "query string"), frame).collect()}
    want, split = {}, lambda t: re.split(r"\s+", t.lower())
    for q in queries:
        for title, keywords, content, examples in sections:
            score = 2 * sum(k in q.lower() for k in keywords) + 3 * any(w in q.lower() for w in split(title)) + sum(any(w in q.lower() for w in split(e)) for e in examples)
            score += 0.5 * len(set(split(content)) & set(split(q))) if content is not None else 0
            if score > 0:
                want[q, title] = score
    assert got == want


def test_text_functions(spark):
    assert value(spark, X.normalised(F.lit(" a \tb\n "))) == "a b"
    assert value(spark, X.query_tokens(F.lit("Fix fix auth.py FIX b"))) == ["Fix", "auth.py"]  # one character is no token
    assert value(spark, X.error_category(F.lit("Invalid format given"))) == "image_format_error"
    kind = lambda *a: value(spark, X.error_category(*a))
    assert kind(F.lit("x"), F.lit("Forbidden")) == "discord_permission_error" and kind(F.lit("x"), F.lit("ConnectionClosed")) == "discord_connection_error"
    assert kind(F.lit("timeout"), F.lit("NotFound")) == kind(F.lit("x"), F.lit("DiscordServerError")) == kind(F.lit("x"), F.lit("HTTPException")) == "discord_http_error"
    assert kind(F.lit("x"), F.lit("MyError"), F.array(F.lit("HTTPException"), F.lit("Exception"))) == "discord_http_error" and kind(F.lit("It Timed Out"), F.lit("OSError")) == "timeout"
    assert kind(F.lit("nano_banana broke")) == "nano_banana_api_error" and kind(F.lit(None).cast("string")) == kind(F.lit("")) == "unknown_error"
    assert value(spark, X.duration_text(F.lit(90061))) == "1d 1h 1m 1s" and value(spark, X.duration_text(F.lit(0))) == "0s"
    assert value(spark, X.hard_split(F.lit(""), 3)) == [""] and value(spark, X.hard_split(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]
    assert value(spark, X.clean_instruction(F.lit("please  remove the car"))) == "Remove the car"
    assert tuple(value(spark, X.edit_kind(F.lit("remove the car and delete it")))) == ("object_removal", pytest.approx(2 / 3))
    usage = lambda j: value(spark, X.token_usage(F.lit(j)))
    assert tuple(usage('{"prompt_tokens": "3", "output_tokens": 4, "total_tokens": 0}')) == (3, 4, 7)
    assert usage('{"total_tokens": 1, "input_tokens": 5}') is None and usage("{}") is None
    content = X.message_content(F.lit(" hi "), F.lit(None), F.lit("default"), F.array(F.struct(F.lit("a.png").alias("filename"), F.lit("image/png").alias("content_type"))), F.lit(1), F.array(F.lit("wave")), F.array(F.struct(F.lit("x" * 200).alias("content"), F.lit("d").alias("kind"), F.lit(0).alias("attachments"), F.lit(0).alias("embeds"), F.lit(0).alias("stickers"))))
    assert value(spark, content) == f"hi [Message type: default | Attached images: a.png | Embeds: 1 | Stickers: wave | Forwarded[1]: {'x' * 180}...]"


def test_sources_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 20, "text")], "message_id long, channel_id long, content_text string")
    old.write.parquet(f"{tmp_path}/index")
    row = tables.read_table(spark, f"{tmp_path}/index", "message_index").first()
    assert row["hidden"] is False and row["attachment_summary"] == "" and row["deleted_at"] is None
    assert tables.conform(old, "message_index").schema == tables.schema_of("message_index") or tables.conform(old, "message_index").columns == tables.schema_of("message_index").names
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.txt").write_bytes("é".encode())
    (tmp_path / "files/b.log").write_bytes(b"\xe9")
    (tmp_path / "files/c.exe").write_bytes(b"x")
    assert sorted(r["text"] for r in tables.read_text_files(spark, f"{tmp_path}/files").collect()) == ["é", "é"]
    types = spark.createDataFrame([(f"file:{tmp_path}/files/c.exe", "application/JSON"), (f"file:{tmp_path}/files/a.txt", "image/png")], "path string, content_type string")
    assert sorted(r["text"] for r in tables.read_text_files(spark, f"{tmp_path}/files", types=types).collect()) == ["x", "é"]
    assert tables.read_text_files(spark, f"{tmp_path}/files", largest=1).count() == 1
    rows = sinks.long_format(spark.createDataFrame([(2, 0.5)], "n int, rate double"), ["n", "rate"])
    sinks.write_csv(rows, f"{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.option("header", "true").csv(f"{tmp_path}/csv").collect())) == [("n", "2.0"), ("rate", "0.5")]
    assert [r["value"] for r in sinks.markdown_lines(rows, "Use").collect()] == ["# Use", "- **n**: 2.00", "- **rate**: 0.50"]
    assert value(spark, sinks.log_line(F.lit("done"), user=F.lit(1), why=F.lit(None))) == "done [user=1]"


def test_cells_at_the_edges_of_a_table(spark):
    """One bar at each end is the frame; more are empty cells, as a walk over the lines finds them."""

    def slow(table):
        lines, rows = table.strip().split("\n"), []
        for line in map(str.strip, lines):
            if not re.match(r"^\|[\s\-:|]+\|$", line):
                cells = [c.strip() for c in line.split("|")]
                cells = cells[1:] if cells and cells[0] == "" else cells
                cells = cells[:-1] if cells and cells[-1] == "" else cells
                rows += [cells] if cells else []
        if len(lines) < 2 or not rows:
            return table
        full = [r + [""] * (max(map(len, rows)) - len(r)) for r in rows]
        widths = [max(len(r[i]) for r in full) for i in range(len(full[0]))]
        out = [" | ".join(c.ljust(w) for c, w in zip(r, widths)) for r in full]
        return "\n".join(["```", out[0], "-+-".join("-" * w for w in widths), *out[1:], "```"])

    rng = random.Random(8)
    tables_ = ["|| x |\n|---|---|\n| a | b |", "| a |\n||\n| | |", "a | b\n--- | ---\nc"]
    tables_ += ["\n".join("|".join(rng.choice(["", " ", "x", "long cell", "--", ":-:"]) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(4))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(tables_)), "i long, t string")
    assert {r["i"]: r["block"] for r in markup.table_blocks(rows, "i", "t").collect()} == {i: slow(t) for i, t in enumerate(tables_)}


def test_usage_by_increments_after_any_cut(spark, tmp_path):
    """Totals of all batches so far equal the sums over all events, retractions and merges included."""
    from palaver.operators import usage_log
    from palaver.sources.runs import Runs

    rng, live, rows = random.Random(4), [], []
    for seq in range(300):
        if live and rng.random() < 0.25:
            event = live.pop(rng.randrange(len(live)))
            rows.append((seq, "retract", event[2], None, *event[4:]))
        else:
            counts = [rng.randrange(-1 if rng.random() < 0.1 else 0, 50) for _ in range(2)]
            event = (seq, "add", rng.randrange(9), rng.choice([None, f"name{seq}"]), *counts, sum(map(abs, counts)) if rng.random() > 0.05 else None)
            rows.append(event)
            live.append(event)
    schema = "seq long, op string, user_id long, username string, input_tokens long, output_tokens long, total_tokens long"
    cuts, path = [0, *sorted(rng.sample(range(300), 9)), 300], f"{tmp_path}/u"
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2):  # the second time it is known
            usage_log.apply_usage(spark.createDataFrame(rows[a:b], schema), path, i)
        want = {}
        for seq, op, user, name, *counts in rows[:b]:
            if all(c is not None and c >= 0 for c in counts):
                sign = 1 if op == "add" else -1
                t = want.setdefault(user, [None, 0, 0, 0, 0])
                t[0] = name if op == "add" and name else t[0]
                t[1:] = [x + sign * y for x, y in zip(t[1:], [1, *counts])]
        want = {u: tuple(t) for u, t in want.items() if t[1] > 0}
        got = {r["user_id"]: tuple(r)[1:] for r in usage_log.totals(spark, path).collect()}
        assert {u: t[1:] for u, t in got.items()} == {u: t[1:] for u, t in want.items()}
    assert got == want and len(Runs(spark, path).live()) < 10
    usage_log.merge(spark, path)
    best = sorted(want.items(), key=lambda x: (-x[1][4], x[0]))[:3]
    assert [r["user_id"] for r in usage_log.leaders(spark, path, 3).collect()] == [u for u, _ in best] and usage_log.rollup(spark, path).first()["users"] == len(want)


def test_images_and_their_sizes(spark, tmp_path):
    (tmp_path / "i").mkdir()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08" + (300).to_bytes(2, "big") + (400).to_bytes(2, "big") + bytes(9)
    webp = lambda kind, rest: b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + rest + bytes(20)
    files = {
        "a.png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"), ("image/png", 7, 9)), "b.GIF": (b"GIF89a" + bytes([5, 1, 6, 0]), ("image/gif", 261, 6)), "c.jpg": (jpeg, ("image/jpeg", 400, 300)),
        "d.webp": (webp(b"VP8X", b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), ("image/webp", 100, 50)), "e.webp": (webp(b"VP8L", b"\x2f" + (31 | 63 << 14).to_bytes(4, "little")), ("image/webp", 32, 64)),
        "f.webp": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + (640).to_bytes(2, "little") + (480).to_bytes(2, "little")), ("image/webp", 640, 480)), "g.png": (b"no image", (None, None, None)), "h.jpeg": (b"\xff\xd8\xff\xd9", (None, None, None)), "j.bin": (b"GIF87a\1\0\1\0", ("image/gif", 1, 1)), "k.bin": (b"x", None), "l.png": (bytes(5000), None),
    }
    for name, (data, _) in files.items():
        (tmp_path / "i" / name).write_bytes(data)
    types = spark.createDataFrame([(f"file:{tmp_path}/i/j.bin", "image/gif")], "path string, content_type string")
    rows = tables.read_images(spark, f"{tmp_path}/i", 4000, types).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["format"], r["width"], r["height"]) for r in rows} == {k: v for k, (_, v) in files.items() if v}
    assert all(len(r["content"]) == r["length"] for r in rows) and "content" not in tables.read_images(spark, f"{tmp_path}/i", 9, with_content=False).columns


def test_attachments_that_are_read_as_text(spark):
    cases = [("a.PY", None, True), ("a.pdf", "text/plain", False), ("a.bin", "text/x-odd", True), ("a.bin", "application/ld+json", True), ("x.png", "image/svg+xml", False), ("noending", None, False), ("b.dart", "application/octet-stream", True), ("b", "application/pdf", False)]
    rows = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(cases)], "i int, n string, t string")
    assert [r[0] for r in rows.orderBy("i").select(tables.is_text(F.col("n"), F.col("t"))).collect()] == [c[2] for c in cases]


def test_backfill_takes_the_newest_of_each_channel(spark, tmp_path):
    from palaver.operators import fulltext
    from palaver.streaming import index

    rows = [(i, i % 2, 50 + i % 3, i % 3 == 0, f"word{i} common" if i % 5 else " ", T0 + timedelta(minutes=i)) for i in range(40)]
    history = spark.createDataFrame(rows, "message_id long, channel_id long, author_id long, is_bot boolean, content string, created_at timestamp")
    taken = {}
    for channel in (0, 1):
        newest = sorted((r for r in rows if r[1] == channel), key=lambda r: -r[0])[:12]
        taken[channel] = (len(newest), {r[0] for r in newest if r[4].strip() and (not r[3] or r[2] == 50)})
    events, counts = changes.backfill(history, own_bot=50, most=12)
    assert {r["channel_id"]: (r["messages"], r["indexed"]) for r in counts.collect()} == {c: (n, len(ids)) for c, (n, ids) in taken.items()}
    path, every = f"{tmp_path}/i", set().union(*(ids for _, ids in taken.values()))
    for _ in range(2):
        index.backfill(history, path, 0, 50, 12)
    assert {r["key"] for r in fulltext.search(spark, path, "common", 100).collect()} == every
    # the stream's batches have numbers of their own, and its later words count
    edit = spark.createDataFrame([(10**17, "upsert", min(every), "changed"), (10**17 + 1, "delete", max(every), None)], "seq long, op string, message_id long, content string")
    fulltext.keep_up(edit, path, 0)
    index.backfill(history, path, 1, 50, 12)
    assert {r["key"] for r in fulltext.search(spark, path, "common", 100).collect()} == every - {min(every), max(every)}
    assert [r["key"] for r in fulltext.search(spark, path, "changed", 100).collect()] == [min(every)]
    assert changes.backfill(history, most=0)[1].count() == 0 and changes.backfill(history)[0].count() == sum(not r[3] and r[4].strip() != "" for r in rows)
