"""Plans whose work must not grow faster than the tables."""

import datetime
import random
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quoin.operators import accounts, admission, text_index
from quoin.plans import registry
from quoin.plans.registry import QUERIES
from quoin.sources import market

START = datetime.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_codes_of_crowded_windows_are_counted_by_running_sums(spark, hot_rows):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.choice([rnd.randint(0, 90), rnd.randint(0, 90), 30, None])) for i in range(300)]
    made = [(i, p, None if at is None else START + datetime.timedelta(minutes=at)) for i, p, at in rows]
    codes = spark.createDataFrame(made, "id long, phone_key int, created_at timestamp_ntz").repartition(3)
    found = accounts.sent_within(codes, {"short": "10 minutes", "long": "60 minutes"}, hot_rows)

    def sent(p, at, minutes):
        return sum(q == p and (b == at if at is None or b is None else at - minutes <= b <= at) for _, q, b in rows)

    assert {(r.id, r.short, r.long) for r in found.collect()} == {(i, sent(p, at, 10), sent(p, at, 60)) for i, p, at in rows}
    assert "RangeFrame" not in plan(accounts.otp_refusals(codes))  # a sliding window counts its rows anew for each code


def moves_of_lines(df) -> int:
    """Shuffles of whole tables of lines: those to a fixed number of tasks or by a key, broadcasts and totals left out."""
    return plan(df).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="the test tables aren't here")
@pytest.mark.parametrize(("name", "most"), [("order_change_history", 2), ("order_change_orders", 2), ("order_calls", 2), ("lifecycle_fold", 2)])
def test_orders_with_made_up_requests_move_once(spark, name, most):
    """Lines and checkouts move once each; orders aren't joined with requests made of themselves."""
    assert moves_of_lines(QUERIES[name](spark, DATA)) <= most


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["order_change_history", "order_place_items", "order_place_verdicts", "order_place_orders", "order_calls", "lifecycle_fold", "cart_totals"])
def test_tasks_grow_in_number_with_the_lines(spark, name, monkeypatch):
    """The session's eight shuffle tasks would hold ever more lines each."""
    monkeypatch.setattr(market, "TASK_LINES", 60)
    m = market.Market(spark, DATA)
    assert m.parts == -(-m.raw("lineitem").count() // 60) > 50
    moved = [int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan(registry.BUILDERS[name](m)))]
    assert moved and set(moved) == {m.parts}


def test_the_index_shuffles_lists_and_not_single_ids(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 3).selectExpr("id", "concat('same text ', cast(id % 7 as string), ' \U0001f600é') as title")
    parts = rows.mapInArrow(text_index.posting_lists, "gram string, block long, ids array<long>")
    found = parts.select("gram", F.explode("ids").alias("id"))
    want = rows.select(F.explode(text_index.trigrams(F.col("title"))).alias("gram"), "id")
    assert sorted(found.collect()) == sorted(want.collect())
    assert parts.count() <= 3 * 40 < found.count()
    made = iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 70000]), pa.array(["abcd", None, "ab"])], names=["id", "text"])])
    monkeypatch.setattr(text_index, "HELD_IDS", 1)
    split = [r for b in text_index.posting_lists(made) for r in b.to_pylist()]
    assert sorted((r["gram"], r["block"], *r["ids"]) for r in split) == [("abc", 0, 1), ("bcd", 0, 1)]


def test_bounds_judge_carts_without_joining_lines_with_themselves(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(admission, "store", lambda df, name: plans.append(plan(df)) or df)
    lines = spark.createDataFrame([(1, 7, 1, 2, 3), (2, 7, 2, 2, 3), (None, 7, 3, 1, 3), (None, 8, 3, 1, 0)], "checkout_id long, variant_id long, placed_at int, need long, free long")
    found = admission.by_bounds(lines.withColumn("state", F.lit(None).cast("boolean")), 100)
    assert {(r.checkout_id, r.variant_id): r.state for r in found.collect()} == {(1, 7): True, (2, 7): None, (None, 7): False, (None, 8): False}
    assert len(plans) == 1 and "Join" not in plans[0]
