"""Admission, ranks and running sums against loops, on every way that they can take."""

import random

import pytest
from pyspark.sql import functions as F

from quoin.operators import admission as way
from quoin.operators import ranking
from quoin.operators.admission import admission
from quoin.operators.ranking import components, running_sums, with_serials
from quoin.sources.stored import store


def by_loop(requests, stock):
    """requests: (checkout, variant, at, quantity); one cart after the other."""
    key = lambda x: (x is not None, x or 0)
    at = {}
    for c, _, t, _ in requests:
        at[c] = min(t, at.get(c, t))
    left, admitted = dict(stock), {}
    for c in sorted(at, key=lambda c: (at[c], key(c))):
        need = {}
        for v, q in [(r[1], r[3]) for r in requests if r[0] == c]:
            need[v] = need.get(v, 0) + (q if q and q > 0 else 10**9)
        admitted[c] = all(left.get(v, 0) >= n for v, n in need.items())
        if admitted[c]:
            for v, n in need.items():
                left[v] -= n
    return admitted, left


def check(spark, requests, stock, **more):
    frame = spark.createDataFrame(requests, "checkout_id long, variant_id long, placed_at int, quantity int").repartition(5)
    got = admission(frame, spark.createDataFrame(list(stock.items()), "variant_id long, available int"), **more).collect()
    want, left = by_loop(requests, stock)
    assert sorted((repr(r.checkout_id), repr(r.variant_id), repr(r.quantity), r.admitted) for r in got) == sorted((repr(c), repr(v), repr(q), want[c]) for c, v, _, q in requests)
    lowest = {}
    for r in got:
        lowest[r.variant_id] = min(r.left, lowest.get(r.variant_id, r.left))
    assert lowest == {v: left.get(v, 0) for v in {r[1] for r in requests}}
    return want


def made(seed, carts=70, variants=12):
    rnd = random.Random(seed)
    requests = [(i, rnd.randint(1, variants + 1), i * 7 % 23, rnd.choice([1, 1, 2, 5, 3, None if i == 50 else 2, 0 if i == 60 else 2])) for i in range(carts) for _ in range(rnd.randint(1, 4))]
    requests += [(None, 2, 3, 1), (None, 3, 4, 2), (900, None, 1, 1)]
    return requests, {k: rnd.randint(5, 30) for k in range(1, variants + 1)}


@pytest.mark.parametrize("more", [{}, {"rounds": 0}, {"rounds": 1, "fold_lines": 40, "hot_rows": 30}])
def test_every_way_gives_what_a_loop_gives(spark, more):
    requests, stock = made(5)
    want = check(spark, requests, stock, **more)
    assert 0 < sum(want.values()) < len(want)


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    """Each cart wants the unit that the cart before it may have taken."""
    n = 1000
    requests = [(i, v, i, 1) for i in range(n) for v in (i, i + 1)]
    stored = []
    for module in (way, ranking):
        monkeypatch.setattr(module, "store", lambda df, name: stored.append(name) or store(df, name))
    want = check(spark, requests, {v: 1 for v in range(n + 1)})
    assert [want[i] for i in range(4)] == [True, False, True, False] and len(stored) < 12
    few = len(stored)
    stored.clear()
    check(spark, [r for r in requests if r[0] < 40], {v: 1 for v in range(n + 1)})
    assert len(stored) == few


def test_components_are_folded_apart(spark):
    requests = [(100 * g + i, 50 * g + v, i, 1) for g in range(5) for i in range(12) for v in (i, i + 1)]
    check(spark, requests, {50 * g + v: 1 for g in range(5) for v in range(20)}, rounds=1, fold_lines=30)


def test_no_requests(spark):
    none = spark.createDataFrame([], "checkout_id long, variant_id long, placed_at int, quantity int")
    assert admission(none, spark.createDataFrame([(1, 1)], "variant_id long, available int")).collect() == []


def test_serials_are_gapless_in_order(spark):
    rnd = random.Random(1)
    values = [rnd.randint(0, 50) for _ in range(999)] + [None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v int").repartition(7)
    found = with_serials(rows, ["v", "id"], base=100)
    want = sorted(range(1000), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert [r.id for r in sorted(found.collect(), key=lambda r: r.serial)] == want
    assert sorted(r.serial for r in found.collect()) == list(range(101, 1101))
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    assert with_serials(rows.limit(0), ["v"]).collect() == []


@pytest.mark.parametrize("hot_rows", [10**6, 100, 5])
def test_running_sums(spark, hot_rows):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, 1, 2, -3])) for i in range(600)]
    df = store(spark.createDataFrame(rows, "i int, k int, q int").repartition(6), "rows")
    sums, want = {}, []
    for i, k, q in rows:
        sums[k] = sums.get(k, 0) + (q or 0)
        want.append((i, sums[k]))
    assert sorted((r.i, r.total) for r in running_sums(df, "k", ["i"], {"total": F.col("q")}, hot_rows).collect()) == want


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(0, 400), rnd.randint(0, 300)) for _ in range(330)] + [(1000 + i, 2000 + i + d) for i in range(60) for d in (0, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, v in links:
        parent[find(("v", v))] = find(("n", n))
    groups = {}
    for n, _ in links:
        groups.setdefault(find(("n", n)), set()).add(n)
    want = {n: min(g) for g in groups.values() for n in g}
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()} == want
