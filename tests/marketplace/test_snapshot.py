from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quoin.operators import snapshot
from quoin.operators.orders import AS_OF, expired
from quoin.operators.snapshot import my_orders, sweep
from quoin.sources.market import Market
from quoin.sources.stored import store

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the test tables aren't here")


def test_reads_after_a_sweep_take_its_tables(spark):
    m = Market(spark, DATA)
    lapsed = {r.checkout_id for r in expired(m.checkout, AS_OF).collect()}
    swept = sweep(m)
    assert lapsed and {r.checkout_id for r in swept.released.collect()} == lapsed
    before, after = ({r.checkout_id: r.status for r in x.checkout.collect()} for x in (m, swept))
    assert after == {k: "CANCELLED" if k in lapsed else s for k, s in before.items()}
    assert expired(swept.checkout, AS_OF).count() == 0 and sweep(swept).released.count() == 0
    units = m.order_item.filter(F.col("checkout_id").isin(list(lapsed))).agg(F.sum("quantity")).first()[0]
    reserved = [x.product_variant.agg(F.sum("reserved_stock")).first()[0] for x in (m, swept)]
    assert reserved[0] - reserved[1] == units
    for read in (swept.vendor_order, swept.commission, my_orders(swept)):
        assert "orders.parquet" not in " ".join(read.inputFiles()) and "checkout-" in " ".join(read.inputFiles())


def test_a_sweep_that_fails_leaves_the_market(spark, monkeypatch):
    m, made = Market(spark, DATA), []

    def fails(df, name):
        made.append(name)
        if len(made) == 3:
            raise OSError("disk")
        return store(df, name)

    monkeypatch.setattr(snapshot, "store", fails)
    with pytest.raises(OSError):
        sweep(m)
    assert m.checkout.filter("status = 'PENDING'").count() > 0 and "orders.parquet" in " ".join(m.checkout.inputFiles())


def test_pages_hold_every_order_once(spark):
    m = Market(spark, DATA)
    whole = {(r.customer_id, r.place): (r.checkout_id, r.vendor_id) for r in my_orders(m, limit=10_000).collect()}
    first = my_orders(m, limit=3)
    last = first.filter("place = 3").withColumn("placed_at", F.col("placed_at").cast("timestamp_ntz"))
    second = my_orders(m, limit=3, after=last).join(last.select("customer_id"), "customer_id", "left_semi").collect()
    assert second and all(whole[r.customer_id, r.place + 3] == (r.checkout_id, r.vendor_id) for r in second)
    assert all(r.has_next == ((r.customer_id, r.place + 4 - (r.place - 1) % 3) in whole) for r in first.filter("place = 1").collect())
    assert {(r.customer_id, r.place): (r.checkout_id, r.vendor_id) for r in first.collect()} == {k: v for k, v in whole.items() if k[1] <= 3}
