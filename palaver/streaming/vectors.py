"""States of messages' vectors as a stream: what is to be embedded, and again when its wait is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palaver.operators.changes import MOST_ATTEMPTS
from palaver.streaming.state import use_rocksdb

EVENTS = "seq bigint, op string, message_id bigint, hash string, at timestamp, error string"
OUT = "message_id bigint, kind string, seq bigint, hash string, status string, attempts int, next_retry_at timestamp, last_error string"
STATE = "seq bigint, hash string, shown boolean, done boolean, attempts int, failed_us bigint, due_us bigint, error string, touched_us bigint"


def advanced(state: dict | None, events: list[tuple]) -> dict | None:
    """The state after events (seq, op, hash, at in microseconds, error) in order of seq; those not after the last are known.

    New content resets to pending, the same content changes nothing.  A vector counts only for the
    content in force, a failure for any; after MOST_ATTEMPTS the key is given up, until it is reset.
    """
    for seq, op, given, at, error in sorted(events, key=lambda e: e[0]):
        if state and seq <= state["seq"]:
            continue
        new = state or {"hash": None, "shown": False, "done": False, "attempts": 0, "failed_us": None, "due_us": None, "error": None}
        state = {**new, "seq": seq, "touched_us": at}
        fresh = {"attempts": 0, "failed_us": None, "due_us": None, "error": None}
        if op == "content":
            if state["hash"] != given:
                state |= {"hash": given, "shown": True, "done": False, **fresh}
        elif op == "ok" and state["shown"] and given == state["hash"]:
            state |= {"done": True, **fresh}
        elif op == "fail" and state["shown"]:
            n = state["attempts"] + 1
            wait = min(60 * 2 ** (n - 1), 3600) * 1_000_000
            state |= {"attempts": n, "failed_us": at, "due_us": at + wait if n < MOST_ATTEMPTS else None, "error": (error or "embedding failed")[:500]}
    return state


def row_of(key: int, kind: str, state: dict) -> tuple:
    status = "failed" if state["attempts"] >= MOST_ATTEMPTS else "pending" if state["attempts"] or not state["done"] else "done"
    due = None if state["due_us"] is None else pd.Timestamp(state["due_us"], unit="us")
    return (key, kind, state["seq"], state["hash"], status, state["attempts"], due, state["error"])


class VectorStates(StatefulProcessor):
    """A key's state is a value; its one timer is the end of its wait, or of its keeping."""

    def __init__(self, keep_seconds: int | None):
        self.keep_us = None if keep_seconds is None else keep_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("vector", STATE)
        self.names = [f.split()[0] for f in STATE.split(", ")]

    def _read(self) -> dict | None:
        return dict(zip(self.names, self.value.get(), strict=True)) if self.value.exists() else None

    def _timer(self, state: dict) -> int | None:
        """Milliseconds, rounded up so that a timer never comes before its time."""
        if state["due_us"] is not None:
            return -(-state["due_us"] // 1000)
        settled = state["done"] or state["attempts"] >= MOST_ATTEMPTS
        return -(-(state["touched_us"] + self.keep_us) // 1000) if settled and self.keep_us is not None else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._read()
        none = lambda x: None if pd.isna(x) else x
        events = [(int(r.seq), r.op, none(r.hash), int(r.us), none(r.error)) for frame in rows for r in frame.itertuples(index=False)]
        state = advanced(before, events)
        old, new = self._timer(before) if before else None, self._timer(state)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.value.update(tuple(state[n] for n in self.names))
        if state["shown"] and state != before:
            yield pd.DataFrame([row_of(int(key[0]), "state", state)], columns=[f.split()[0] for f in OUT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._read()
        if state is None or self._timer(state) != expiredTimerInfo.getExpiryTimeInMs():
            return
        if state["due_us"] is None:
            self.value.clear()
            return
        yield pd.DataFrame([row_of(int(key[0]), "due", state)], columns=[f.split()[0] for f in OUT.split(", ")])
        # the wait is over: what comes next is an answer, and needs no timer
        state["due_us"] = None
        self.value.update(tuple(state[n] for n in self.names))

    def close(self) -> None:
        pass


def vector_states(events: DataFrame, late: str = "1 hour", keep_seconds: int | None = None) -> DataFrame:
    """(OUT) of a stream of EVENTS: a row of kind ``state`` for each message that a batch changes, and of kind ``due``
    once the watermark (``late`` behind the newest event) has passed a message's ``next_retry_at``.

    The last ``state`` row of a message is its row in ``changes.embedding_state`` of the same events,
    in whatever batches they came, if they come in order of seq; repeated ones do no harm.  Messages
    that are done or given up are forgotten ``keep_seconds`` after their last event, if that is given;
    the same content is then taken for new.  Events later than the watermark are dropped by Spark.
    """
    use_rocksdb(events.sparkSession)
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    slim = timed.select("message_id", "seq", "op", "hash", F.unix_micros("at").alias("us"), "error", "at")
    return slim.groupBy("message_id").transformWithStateInPandas(VectorStates(keep_seconds), OUT, "Append", "EventTime")
