"""Reservations that lapse, as a stream with a timer for each order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Holds(StatefulProcessor):
    """One order: ``expires`` is when its reservation lapses (-1 before it is placed), ``left`` the earliest moment at which its status
    changed (-1: not yet). The state lives no longer than the timer."""

    def __init__(self, minutes: int):
        self.length = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hold", "expires long, left long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expires, left = self.state.get() if self.state.exists() else (-1, -1)
        due = expires
        for batch in rows:
            for at, kind in zip(batch["at"], batch["kind"], strict=True):
                now = int(at.timestamp() * 1000)
                if kind == "placed":
                    expires = now + self.length if expires < 0 else min(expires, now + self.length)
                else:
                    left = now if left < 0 else min(left, now)
        # A change that comes before its order is waited with for as long as a reservation lasts.
        timer = expires if expires >= 0 else left + self.length
        for old in [t for t in self.handle.listTimers() if t != timer]:
            self.handle.deleteTimer(old)
        if 0 <= left < expires:
            self.handle.deleteTimer(timer)
            self.state.clear()
        else:
            if due != timer:
                self.handle.registerTimer(timer)
            self.state.update((expires, left))
        yield pd.DataFrame({"order_id": [], "expires_at": pd.Series([], dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expires, _ = self.state.get()
        self.state.clear()
        gone = [(key[0], pd.Timestamp(expires, unit="ms"))] if expires >= 0 else []
        yield pd.DataFrame(gone, columns=["order_id", "expires_at"]).astype({"expires_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def lapsed(events: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Orders of a stream (order_id, at, kind: 'placed' or any other for a change of status) that nothing changed before their
    reservation's end, when the watermark has passed it: order_id, expires_at. A change at the very end comes too late.

    Every order has a timer and two numbers of state, which go with its first change or its end; a change that comes before its
    order waits. Needs the RocksDB state store (``ROCKS`` as spark.sql.streaming.stateStore.providerClass)."""
    seen = events.select("order_id", F.col("at").cast("timestamp").alias("at"), "kind").withWatermark("at", late)
    return seen.groupBy("order_id").transformWithStateInPandas(Holds(minutes), "order_id long, expires_at timestamp", "Append", "EventTime")
