"""Live chat: each channel's messages wait in a queue and are answered as one batch, with a pause after each answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palaver.streaming.state import use_rocksdb

MESSAGE = "message_id bigint, author_id bigint, content string"
OUT = "channel_id bigint, number bigint, size int, messages array<struct<message_id: bigint, author_id: bigint, content: string>>"


class Queue:
    """What happens to a channel's queue; times in milliseconds.

    ``pause_ends`` is the end of the pause after the last batch, or None while the channel is idle.
    """

    def __init__(self, pause: int, enabled: bool, number: int, pause_ends: int | None, waiting: list[tuple]):
        self.pause, self.enabled, self.number, self.pause_ends, self.waiting = pause, enabled, number, pause_ends, list(waiting)

    def _drained(self, now: int) -> tuple[int, list[tuple]]:
        batch, self.waiting = self.waiting, []
        self.number, self.pause_ends = self.number + 1, now + self.pause
        return self.number, batch

    def arrived(self, events: list[tuple], now: int) -> tuple[int, list[tuple]] | None:
        """Events in order: ('message', row) or ('setting', enabled); a batch to answer, if the channel was idle."""
        for kind, value in events:
            if kind == "setting":
                self.enabled = bool(value)
                if not self.enabled:
                    self.waiting = []
            elif self.enabled:
                self.waiting.append(value)
        if self.waiting and self.pause_ends is None:
            return self._drained(now)
        return None

    def rested(self, now: int) -> tuple[int, list[tuple]] | None:
        """The pause is over: all that has come meanwhile is the next batch, or the channel is idle."""
        if self.waiting and self.enabled:
            return self._drained(now)
        self.waiting, self.pause_ends = [], None
        return None


class LiveQueues(StatefulProcessor):
    """A channel's waiting messages are a list; its setting, its batches' number and the end of its pause are a value."""

    def __init__(self, pause_seconds: float, enabled: bool):
        self.pause, self.default = int(pause_seconds * 1000), enabled

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("channel", "enabled boolean, number bigint, pause_ends bigint")
        self.waiting = handle.getListState("waiting", MESSAGE)

    def _queue(self, with_list: bool) -> Queue:
        enabled, number, ends = self.value.get() if self.value.exists() else (self.default, 0, None)
        return Queue(self.pause, enabled, number, ends, [tuple(r) for r in self.waiting.get()] if with_list and self.waiting.exists() else [])

    def _kept(self, queue: Queue) -> None:
        self.value.update((queue.enabled, queue.number, queue.pause_ends))
        if queue.waiting:
            self.waiting.put(queue.waiting)
        else:
            self.waiting.clear()

    def _out(self, key: tuple, batch: tuple[int, list[tuple]]) -> pd.DataFrame:
        number, rows = batch
        names = [f.split()[0] for f in MESSAGE.split(", ")]
        return pd.DataFrame([(int(key[0]), number, len(rows), [dict(zip(names, r, strict=True)) for r in rows])], columns=["channel_id", "number", "size", "messages"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        none = lambda x: None if pd.isna(x) else x
        found = sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: (r.us, r.message_id if pd.notna(r.message_id) else -1))
        whole = lambda x: None if pd.isna(x) else int(x)
        events = [("message", (whole(r.message_id), whole(r.author_id), none(r.content))) if pd.isna(r.enabled) else ("setting", bool(r.enabled)) for r in found]
        queue = self._queue(True)
        batch = queue.arrived(events, now)
        self._kept(queue)
        if batch:
            self.handle.registerTimer(queue.pause_ends)
            yield self._out(key, batch)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        queue = self._queue(True)
        if queue.pause_ends != expiredTimerInfo.getExpiryTimeInMs():
            return
        batch = queue.rested(timerValues.getCurrentProcessingTimeInMs())
        self._kept(queue)
        if batch:
            self.handle.registerTimer(queue.pause_ends)
            yield self._out(key, batch)

    def close(self) -> None:
        pass


def live_queues(messages: DataFrame, settings: DataFrame, pause_seconds: float = 2.0, enabled: bool = False) -> DataFrame:
    """(channel_id, number, size, messages): the batches to answer, of two streams.

    ``messages``: channel_id, message_id, author_id, content, at; ``settings``: channel_id, enabled, at.
    A message of an idle channel is answered at once, with all that came beside it; what comes during
    the pause after a batch waits, and is the next batch when the pause is over.  A channel that is
    switched off loses what waits, and takes nothing until it is switched on; ``enabled`` is what holds
    for channels without a setting.  Every batch counts as answered.  Run it with a trigger as short as
    pauses should be exact.
    """
    use_rocksdb(messages.sparkSession)
    micros = F.unix_micros(F.col("at").cast("timestamp")).alias("us")
    said = messages.select("channel_id", micros, "message_id", "author_id", "content", F.lit(None).cast("boolean").alias("enabled"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("message_id", "bigint"), ("author_id", "bigint"), ("content", "string"))]
    both = said.unionByName(settings.select("channel_id", micros, *none, "enabled"))
    return both.groupBy("channel_id").transformWithStateInPandas(LiveQueues(pause_seconds, enabled), OUT, "Append", "ProcessingTime")
