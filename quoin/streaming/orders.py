"""Structured Streaming forms: order states, code limits, expiry of reservations, rate windows and toggles over event streams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quoin.functions import rules


def code_requests(codes: DataFrame, late: str = "10 minutes", window: str = "10 minutes", slide: str = "5 minutes", most: int = 3) -> DataFrame:
    """Codes by phone and sliding window of a stream (phone_key, created_at), and whether the limit is reached. State is dropped
    when the watermark passes a window's end."""
    by = codes.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    counts = by.groupBy(F.window("created_at", window, slide), "phone_key").agg(F.count("*").alias("sent"))
    return counts.select("phone_key", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "sent", (F.col("sent") >= most).alias("refused"))


def order_states(changes: DataFrame, late: str = "1 hour", forget_days: int = 90) -> DataFrame:
    """Each change of a stream (order_id, at, target, actor) with whether the order rules take it ('ok' or 'refused') and the order's
    status afterwards. Orders begin as PENDING. Changes that come together are taken in order of time, target and actor.
    The state of an order is its status; it is dropped forget_days of event time after its last change."""
    edges = {(a, b): (*actors, "ADMIN") for a, b, actors in rules.EDGES}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, last = state.get if state.exists else ("PENDING", 0)
        rows = pd.concat(list(batches)).sort_values(["at", "target", "actor"])
        out = []
        for at, target, actor in zip(rows["at"], rows["target"], rows["actor"], strict=True):
            ok = actor in edges.get((status, target), ())
            status = target if ok else status
            out.append((key[0], at, target, actor, "ok" if ok else "refused", status))
        last = max(last, int(rows["at"].max().timestamp() * 1000))
        state.update((status, last))
        state.setTimeoutTimestamp(max(last + forget_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["order_id", "at", "target", "actor", "verdict", "status"])

    seen = changes.select("order_id", F.col("at").cast("timestamp").alias("at"), "target", "actor").withWatermark("at", late).groupBy("order_id")
    return seen.applyInPandasWithState(fold, "order_id long, at timestamp, target string, actor string, verdict string, status string", "status string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def code_limits(codes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each code of a stream (phone_key, id, created_at) with how many were sent to its phone in the 10 and in the 60 minutes before, both
    bounds included, and whether 3 or 8 of them refuse it. The state of a phone is the times of its last 60 minutes; it is
    dropped when the watermark passes them. Codes that come later than codes behind them don't change what was said of those."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
        for code, at in zip(rows["id"], rows["created_at"], strict=True):
            now = int(at.timestamp() * 1000)
            short, long = (bisect_right(times, now) - bisect_left(times, now - minutes * 60_000) for minutes in (10, 60))
            out.append((key[0], code, at, short, long, short >= 3 or long >= 8))
            insort(times, now)
        times = times[bisect_left(times, times[-1] - 3_600_000) :]
        state.update((times,))
        state.setTimeoutTimestamp(max(times[-1] + 3_600_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["phone_key", "id", "created_at", "short", "long", "refused"])

    seen = codes.select("phone_key", "id", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", late).groupBy("phone_key")
    return seen.applyInPandasWithState(count, "phone_key string, id long, created_at timestamp, short long, long long, refused boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def unconfirmed(placed: DataFrame, confirmed: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Orders of a stream (order_id, placed_at) that no event of the other stream (order_id, confirmed_at) confirms within the
    reservation's minutes: they are released. An outer join with a time bound, so both sides' state is bounded."""
    a = placed.select("order_id", F.col("placed_at").cast("timestamp").alias("placed_at")).withWatermark("placed_at", late)
    b = confirmed.select(F.col("order_id").alias("confirmed_id"), F.col("confirmed_at").cast("timestamp").alias("confirmed_at")).withWatermark("confirmed_at", late)
    until = F.col("placed_at") + F.expr(f"interval {minutes} minutes")
    met = a.join(b, (F.col("order_id") == F.col("confirmed_id")) & (F.col("confirmed_at") >= F.col("placed_at")) & (F.col("confirmed_at") < until), "left_outer")
    return met.select("order_id", "placed_at", F.when(F.col("confirmed_id").isNull(), "CANCELLED").otherwise("CONFIRMED").alias("status"))


def refused_changes(changes: DataFrame) -> DataFrame:
    """Changes of a stream (old, target, actor) that the order rules refuse, with the reason; stateless."""
    reason = rules.transition_reason(F.col("old"), F.col("target"), F.col("actor"))
    return changes.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def toggled(toggles: DataFrame) -> DataFrame:
    """Running favourites of a stream of toggles (user_id, product_id): held while their number is odd."""
    return toggles.groupBy("user_id", "product_id").agg(F.count("*").alias("toggles")).withColumn("held", F.col("toggles") % 2 == 1)


def deliver(rows: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hands every micro-batch to ``send`` with its number, at least once; a batch that is sent again has the same number."""
    return rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
