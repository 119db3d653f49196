"""Sessions that rotate: what becomes of each refresh token that is presented.

A session begins with a sign-in and goes on as a chain of tokens: each success revokes the token presented and issues the next.
A presentation names its chain and the token's number there. Presentations find their chain by a join, then each chain is
folded as a stream over sorted rows, which keeps one token's state and no list, however long the chain is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.sources.market import Market


def presented(sessions: DataFrame, log: DataFrame, users: DataFrame, days: int = 30) -> DataFrame:
    """log (id, chain, number, at, kind: refresh or logout) of sessions (chain, user_id, created_at), in the order of (at, id), with a verdict
    and the number of the token that was issued, or null.

    'unknown': no such chain, or its token hasn't been issued yet; 'revoked': it was rotated or logged out; 'expired': issued
    ``days`` or more ago; 'blocked': the user is, and the token is used up though no one gets the next; 'ok': the next token is
    issued. A logout revokes the token if it is known and always answers 'ok', expired or not. Nulls are unknown.
    """
    held = users.select(F.col("id").alias("user_id"), "is_blocked")
    chains = sessions.join(held, "user_id", "left").select(F.col("chain").alias("of"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"), F.coalesce("is_blocked", F.lit(True)).alias("blocked"))
    rows = log.join(chains, F.col("chain") == F.col("of"), "left").select("id", "chain", "number", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), "kind", "created", "blocked")
    lasts = days * 86_400_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, current, issued, open_ = None, 0, 0, True
        for batch in batches:
            ids, verdicts, numbers = [], [], []
            for key, chain, number, at, kind, created, blocked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chain is not None and chain != now:
                    now, current, issued, open_ = chain, 0, created, True
                known = created is not None and chain is not None and number is not None and at is not None and 0 <= number <= current and at >= created
                next_number = None
                if kind == "logout":
                    verdict = "ok"
                    open_ = open_ and not (known and number == current)
                elif not known:
                    verdict = "unknown"
                elif number < current or not open_:
                    verdict = "revoked"
                elif at >= issued + lasts:
                    verdict = "expired"
                else:
                    current, issued = current + 1, at
                    verdict, next_number = ("blocked", None) if blocked else ("ok", current)
                ids.append(key)
                verdicts.append(verdict)
                numbers.append(next_number)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(verdicts, pa.string()), pa.array(numbers, pa.int64())], names=["id", "verdict", "issued"])

    known = rows.filter("created is not null").repartition("chain").sortWithinPartitions("chain", "micros", "id")
    unknown = rows.filter("created is null").select("id", F.when(F.col("kind") == "logout", "ok").otherwise("unknown").alias("verdict"), F.lit(None).cast("long").alias("issued"))
    return known.mapInArrow(fold, "id long, verdict string, issued long").unionByName(unknown)


def sign_ins(m: Market) -> DataFrame:
    return m.otp_code.select(F.col("id").alias("chain"), F.col("phone_key").alias("user_id"), "created_at")


def made_log(m: Market) -> DataFrame:
    """Clicks and errors as presentations of their user's newest session so far; those before any sign-in name none. Every fifth
    error logs out, and every third presentation repeats a token that was used before."""
    acts = m.raw("events").filter(F.col("event_type").isin("click", "error", "signup"))
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id")
    chain = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(so_far)
    rows = acts.withColumn("chain", chain).filter("event_type <> 'signup'")
    place = F.row_number().over(Window.partitionBy("chain", "user_id").orderBy("ts", "event_id")) - 1
    number = F.greatest(F.lit(0), place - F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).cast("long")
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "logout").otherwise("refresh")
    return rows.select(F.col("event_id").alias("id"), "chain", number.alias("number"), F.col("ts").alias("at"), kind.alias("kind"))


def session_rotation(m: Market) -> DataFrame:
    return presented(sign_ins(m), made_log(m), m.app_user, days=5)
