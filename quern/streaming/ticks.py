"""Count-based ticks whose last, open one is flushed once a key falls silent (survey T02, A24)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Calls of a tick; the first one of a key has one more.
CALLS = 10
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "user_id long, tick long, n long, mean_value double, flushed boolean"


class TickProcessor(StatefulProcessor):
    """State of a key: calls and ticks so far, and the values of the open tick, CALLS + 1 at most; a timer for its end."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "calls long, tick long")
        self.open = handle.getListState("open", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        calls, tick = self.counts.get() if self.counts.exists() else (0, 0)
        held = [r[0] for r in self.open.get()] if self.open.exists() else []
        every = pd.concat(list(rows)).sort_values("event_id")
        out = []
        for value in every["value"]:
            held.append(float(value))
            if calls and calls % CALLS == 0:
                out.append((key[0], tick, len(held), sum(held) / len(held), False))
                held, tick = [], tick + 1
            calls += 1
        self.counts.update((calls, tick))
        self.open.clear()
        if held:
            self.open.put([(v,) for v in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(every["ts"].max().timestamp() * 1000) + self.gap_ms)
        yield pd.DataFrame(out, columns=["user_id", "tick", "n", "mean_value", "flushed"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        held, (_, tick) = [r[0] for r in self.open.get()] if self.open.exists() else [], self.counts.get()
        # a key that comes back begins anew, with the next tick
        self.counts.update((0, tick + 1 if held else tick))
        self.open.clear()
        yield pd.DataFrame([(key[0], tick, len(held), sum(held) / len(held), True)] if held else [], columns=["user_id", "tick", "n", "mean_value", "flushed"])

    def close(self) -> None:
        pass


def flushed_ticks(events: DataFrame, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """(user_id, tick, n, mean_value, flushed) of a stream's events: a tick for every CALLS calls of a user, and the open one
    once the watermark, `late` behind the latest event, has passed the user's last event by gap_seconds.

    The query needs the state store of PROVIDER. What a user's state holds is bounded by a tick. Rows without ts fail.
    """
    watched = events.select("event_id", "ts", "user_id", "value").withWatermark("ts", late)
    return watched.groupBy("user_id").transformWithStateInPandas(TickProcessor(gap_seconds * 1000), SCHEMA, "append", "eventTime")
