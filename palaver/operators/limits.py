"""Sliding-window admission: a request counts against later ones only if it was accepted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators import scans
from palaver.session import checkpoint

#: (seconds, requests) rules of the text limiter: both must allow a request.
TEXT_RULES = [(60, 10), (3600, 60)]
#: The image limiter's rule; its window leaves its end out.
IMAGE_RULES = [(3600, 10)]


class Accepted:
    """Accepted times of one user; ``inclusive``: a request exactly a rule's seconds ago still counts."""

    def __init__(self, rules: list[tuple[int, int]], inclusive: bool = True):
        self.rules, self.times, self.edge = rules, deque(), 0 if inclusive else 1

    def admit(self, micros: int) -> bool:
        return self.wait(micros) == 0

    def wait(self, micros: int) -> int:
        """0 if the request is accepted (and counted); else the whole seconds, 1 at least, until the first rule that it breaks lets go."""
        longest = max(s for s, _ in self.rules) * 1_000_000
        while self.times and self.times[0] < micros - longest:
            self.times.popleft()
        for seconds, most in self.rules:
            within = [t for t in self.times if t >= micros - seconds * 1_000_000 + self.edge]
            if len(within) >= most:
                return max(1, (min(within) + seconds * 1_000_000 - micros) // 1_000_000)
        self.times.append(micros)
        return 0


def admitted(requests: DataFrame, user: str, at: str, key: str, rules: list[tuple[int, int]] = TEXT_RULES, inclusive: bool = True, most: int = scans.MOST) -> DataFrame:
    """(user, key, accepted, retry_after) for each request, in order of time and key within a user.

    ``retry_after``: seconds after which a refused request may come again; null if it is accepted.

    Acceptance hangs on earlier acceptances, so a user's requests are taken in order: rows are
    dealt by user, sorted, and streamed; a task holds one user's accepted times, of which the
    rules allow a fixed number, however many requests there are.  After a gap longer than the longest
    rule nothing earlier counts: the requests of a user of more than ``most`` are dealt by the stretches
    between such gaps, and each stretch may be a task of its own.
    """
    kinds = dict(requests.dtypes)
    slim = requests.select(F.col(user).alias("u"), F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    heavy = slim.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("u").alias("h"))  # at most rows / most
    if heavy.isEmpty():
        cut = slim.withColumn("stretch", F.lit(0).cast("bigint"))
    else:
        heavy = checkpoint(heavy)
        of = F.col("u").eqNullSafe(F.col("h"))
        longest = max(s for s, _ in rules)
        stretches = scans.sessions(slim.join(F.broadcast(heavy), of, "left_semi").withColumn("at", F.timestamp_micros("t")), ["u"], "at", "k", longest, "stretch", most).drop("at")
        cut = slim.join(F.broadcast(heavy), of, "left_anti").withColumn("stretch", F.lit(0).cast("bigint")).unionByName(stretches)
    ordered = cut.repartition("u", "stretch").sortWithinPartitions("u", "stretch", "t", "k")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window = object(), Accepted(rules, inclusive)
        for batch in batches:
            out = []
            for own, t in zip(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                if own != current:
                    current, window = own, Accepted(rules, inclusive)
                out.append(window.wait(t))
            columns = [batch.column(0), batch.column(1), pa.array([w == 0 for w in out], pa.bool_()), pa.array([w or None for w in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "k", "accepted", "retry_after"])

    done = ordered.mapInArrow(walk, f"u {kinds[user]}, k {kinds[key]}, accepted boolean, retry_after long")
    return done.toDF(user, key, "accepted", "retry_after")


def retry_minutes(retry_after: Column) -> Column:
    """The same in minutes begun, as it is told to users where an hour's rule refuses."""
    return F.greatest(F.lit(1), F.floor(retry_after / 60) + 1).cast("bigint")


def waits(requests: DataFrame, at: str, key: str, seconds: int = 60, most: int = 30, size: int = scans.MOST) -> DataFrame:
    """(key, wait) of all requests to one service, which delays instead of refusing: every request counts.

    A request that finds ``most`` others within the last ``seconds`` (the end left out) waits until
    the oldest of them is that old.  Times are dealt to spans of ``seconds``; each request is also
    seen by the next span, so that requests are numbered span by span.  A request asks how many are before
    its window; the one after those is the oldest, found by its number: no window is walked for each
    request.  A span of more than ``size`` marks is dealt to several tasks.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    span = seconds * 1_000_000
    timed = requests.select(F.col(key).alias("k"), t.alias("t")).where("t IS NOT NULL").withColumn("own", F.expr(f"t div {span}"))
    mark = lambda of, kind, u: F.struct(of.alias("span"), F.lit(kind).alias("kind"), u.alias("u"))
    # 1: a request; 2: the end of what is before its window, after requests of that very time
    marks = F.array(mark(F.col("own"), 1, F.col("t")), mark(F.col("own") + 1, 1, F.col("t")), mark(F.col("own"), 2, F.col("t") - span))
    seen = scans.running(timed.select("k", "t", "own", F.inline(marks)), ["span"], [F.col("u"), F.col("kind"), F.col("k")], F.col("kind") == 1, "n", size)
    own, request = seen.where("own = span"), F.when(F.col("kind") == 1, F.col("n"))
    # equal requests have numbers that follow each other
    asked = own.groupBy("span", "k", "t").agg(F.min(request).alias("first"), F.max(request).alias("last"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("gone"))
    each = asked.select("k", "t", F.col("span").alias("of"), "gone", F.explode(F.sequence("first", "last")).alias("place"))
    oldest = seen.where("kind = 1").select("span", "n", F.col("t").alias("oldest"))
    marked = each.join(oldest, (F.col("of") == F.col("span")) & (F.col("gone") + 1 == F.col("n")))
    wait = F.when(F.col("place") - 1 - F.col("gone") >= most, (F.col("oldest") + span - F.col("t")) / 1e6).otherwise(0.0)
    return marked.select(F.col("k").alias(key), wait.alias("wait"))


def admitted_batch(batch: DataFrame, allowed: DataFrame, user: str) -> DataFrame:
    """The messages of a batch whose author was admitted: each author takes one slot of a batch."""
    return batch.join(allowed.where("accepted").select(user).distinct(), user, "left_semi")
