import datetime
from pathlib import Path

import duckdb
import pytest

from quoin.operators import orders
from quoin.plans.oracles import ORACLES
from quoin.plans.registry import QUERIES
from quoin.sources.market import Market

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr([plain(v) for v in r]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == want


def test_every_query_has_sql_or_a_brute_force_test():
    assert set(QUERIES) - set(ORACLES) == {"admission_fold", "address_changes"}


def test_order_page_of_one_buyer_and_one_vendor(spark):
    m = Market(spark, DATA)
    rows = orders.order_page(m).collect()
    one = next(r for r in rows if r.status == "COMPLETED")
    assert [h.split("@")[0] for h in one.history.split(",")] == ["PENDING", "CONFIRMED", "PREPARING", "SHIPPED", "DELIVERED", "COMPLETED"] and one.net + one.commission == pytest.approx(one.subtotal)
    key = lambda r: (r.checkout_id, r.vendor_id)
    assert sorted(map(key, orders.order_page(m, customer=one.customer_id).collect())) == sorted(key(r) for r in rows if r.customer_id == one.customer_id)
    assert sorted(map(key, orders.order_page(m, vendor=one.vendor_id).collect())) == sorted(key(r) for r in rows if r.vendor_id == one.vendor_id)
    assert orders.order_page(m, customer=-1).count() == 0
