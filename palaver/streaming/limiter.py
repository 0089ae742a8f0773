"""Admission of a stream of requests: each user's accepted times are the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palaver.operators.limits import TEXT_RULES, Accepted


def admit_stream(requests: DataFrame, user: str, at: str, key: str, rules: list[tuple[int, int]] = TEXT_RULES, late: str = "1 hour") -> DataFrame:
    """(user, key, accepted, retry_after) in arrival order by batch, in time order within one.

    ``retry_after``: seconds after which a refused request may come again; null if it is accepted.

    A user's state holds the accepted times that a rule can still count, never more than the rules
    allow; it ends once the watermark (``late`` behind the newest request) has passed all that a
    rule could reach.  Requests later than the watermark still get an answer, by what is left.
    """
    kinds = dict(requests.dtypes)
    longest = max(s for s, _ in rules)

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = Accepted(rules)
        if state.exists:
            window.times.extend(state.get[0])
        rows = pd.concat(list(frames)).sort_values(["t", "k"])
        wait = [window.wait(int(t)) for t in rows["t"]]
        state.update((list(window.times),))
        state.setTimeoutTimestamp(max(int(rows["t"].max()) // 1000 + longest * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"u": rows["u"], "k": rows["k"], "accepted": [w == 0 for w in wait], "retry_after": pd.array([w or None for w in wait], dtype="Int64")})

    timed = F.col(at).cast("timestamp")
    slim = requests.select(F.col(user).alias("u"), F.col(key).alias("k"), F.unix_micros(timed).alias("t"), timed.alias("at")).withWatermark("at", late)
    out = slim.groupBy("u").applyInPandasWithState(update, f"u {kinds[user]}, k {kinds[key]}, accepted boolean, retry_after long", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.toDF(user, key, "accepted", "retry_after")
