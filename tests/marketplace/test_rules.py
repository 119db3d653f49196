import random

import pytest
from pyspark.sql import functions as F

from quoin.functions import rules, text
from quoin.operators import accounts, catalog, orders, placement, shop
from quoin.sources.market import Market
from quoin.streaming import orders as streaming


def column(spark, values, kind, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_arabic_texts(spark):
    given = ["آمنة", "مُحَمَّد", "عباية", "مصطفى", "موديل ٢٠٢٤", "  دشداشة   رجالية  ", None, "ﬁne Ａ"]
    assert column(spark, given, "string", text.normalize_arabic) == ["امنه", "محمد", "عبايه", "مصطفي", "موديل 2024", "دشداشه رجاليه", "", "fine a"]
    assert column(spark, ["١٢٣", "۴۵۶"], "string", text.latin_digits) == ["123", "456"]
    assert column(spark, ["عباية كم واسع", "--", None], "string", text.slugify) == ["عبايه-كم-واسع", "", ""]
    assert column(spark, ["حذاء رياضي", " "], "string", text.tokenize) == [["حذاء", "رياضي"], []]


def test_phones_and_money(spark):
    given = ["07701234567", "+9647501234567", "009647801234567", "٠٧٧٠ ١٢٣ ٤٥٦٧", "12345", "06701234567", None]
    assert column(spark, given, "string", text.normalize_phone) == ["+9647701234567", "+9647501234567", "+9647801234567", "+9647701234567", None, None, None]
    assert column(spark, ["+9647701234567", "x"], "string", text.local_phone) == ["0770 123 4567", "x"]
    assert column(spark, ["12500", "999.6", None], "string", lambda c: text.format_iqd(c.cast("decimal(12,2)"))) == ["12,500 د.ع", "1,000 د.ع", "٠ د.ع"]
    assert column(spark, ["1000"], "string", lambda c: text.format_iqd(c.cast("decimal(12,2)"), symbol=False)) == ["1,000"]
    assert column(spark, ["12,500 د.ع", "١٢٥٠٠", "", "abc", "-2.5", "1-2"], "string", text.parse_iqd) == [12500, 12500, 0, 0, -2, 0]


def test_commission_and_stock(spark):
    rows = spark.createDataFrame([("100000", "0.1"), ("12500", "0.1"), ("750", "0.29"), ("100", "1.5"), ("-1", "0.1")], "s string, r string")
    got = [r.a for r in rows.select(rules.commission_amount(F.col("s").cast("decimal(12,2)"), F.col("r").cast("decimal(5,4)")).alias("a")).collect()]
    assert [None if a is None else int(a) for a in got] == [10000, 1250, 218, None, None]
    stock = spark.createDataFrame([(10, 3, 7), (10, 3, 8), (2, 5, 1), (10, 3, 0)], "s int, r int, q int")
    assert [tuple(r) for r in stock.select(rules.available(F.col("s"), F.col("r")), rules.reservation_check(F.col("s"), F.col("r"), F.col("q"))).collect()] == [(7, "ok"), (7, "insufficient"), (0, "insufficient"), (7, "invalid_quantity")]


def test_transitions_are_the_edges(spark):
    asked = [(a, b, c) for a in rules.STATUSES for b in rules.STATUSES for c in rules.ACTORS]
    rows = spark.createDataFrame(asked, "a string, b string, c string").select("a", "b", "c", rules.transition_reason(F.col("a"), F.col("b"), F.col("c")).alias("why")).collect()
    open_to = {(a, b): actors for a, b, actors in rules.EDGES}
    for r in rows:
        actors = open_to.get((r.a, r.b))
        want = "same" if r.a == r.b else "terminal" if r.a in rules.FINAL else "no_edge" if actors is None else None if r.c == "ADMIN" or r.c in actors else "role"
        assert r.why == want


def test_admission_against_a_loop(spark):
    rnd = random.Random(3)
    requests = [(i, rnd.randint(1, 6), f"2024-01-{rnd.randint(1, 9):02d} 00:00:00", rnd.choice([0, 1, 2, 5])) for i in range(300)]
    stock = {k: rnd.randint(0, 60) for k in range(1, 6)}
    frame = spark.createDataFrame(requests, "checkout_id long, variant_id long, placed_at string, quantity int").withColumn("placed_at", F.col("placed_at").cast("timestamp_ntz"))
    got = {r.checkout_id: (r.admitted, r.left) for r in orders.admission(frame, spark.createDataFrame(list(stock.items()), "variant_id long, available int")).collect()}
    left = dict(stock)
    for i, v, _, q in sorted(requests, key=lambda r: (r[1], r[2], r[0])):
        ok = 0 < q <= left.get(v, 0)
        if ok:
            left[v] -= q
        assert got[i] == (ok, left.get(v, 0))


def test_admission_refuses_whole_carts(spark):
    rnd = random.Random(6)
    requests = [(i, rnd.randint(1, 7), f"2024-01-{i * 7 % 9 + 1:02d} 00:00:00", rnd.choice([1, 1, 2, 5, None if i == 50 else 3])) for i in range(150) for _ in range(rnd.randint(1, 4))]
    stock = {k: rnd.randint(20, 90) for k in range(1, 7)}
    frame = spark.createDataFrame(requests, "checkout_id long, variant_id long, placed_at string, quantity int").withColumn("placed_at", F.col("placed_at").cast("timestamp_ntz"))
    rows = orders.admission(frame, spark.createDataFrame(list(stock.items()), "variant_id long, available int")).collect()
    left, want, split = dict(stock), {}, 0
    for _, i in sorted({(r[2], r[0]) for r in requests}):
        cart = [(r[1], r[3]) for r in requests if r[0] == i]
        after = dict(left)
        for v, q in cart:
            after[v] = after.get(v, 0) - (q or 10**6)
        want[i] = all(after[v] >= 0 for v, _ in cart)
        split += not want[i] and any(q and left.get(v, 0) >= q for v, q in cart)
        left = after if want[i] else left
    assert len(rows) == len(requests) and {(r.checkout_id, r.admitted) for r in rows} == set(want.items())
    assert split > 10 and {v: min(r.left for r in rows if r.variant_id == v) for v in stock} == {v: left[v] for v in stock}


def test_codes_are_refused_by_either_limit(spark):
    minutes = {"a": [0, 300, 600, 900, 1200], "b": [4, 6, 9, 14], "c": [0, 8, 16, 24, 32, 40, 48, 56, 60, 140]}
    rows = [(k * 100 + m, p, m) for k, (p, ms) in enumerate(minutes.items()) for m in ms]
    codes = spark.createDataFrame(rows, "id long, phone_key string, m long").select("id", "phone_key", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m)").alias("created_at"))
    want = {i for i, p, m in rows if sum(m - 10 <= x <= m for x in minutes[p]) - 1 >= 3 or sum(m - 60 <= x <= m for x in minutes[p]) - 1 >= 8}
    assert {r.id for r in accounts.otp_refusals(codes).collect() if r.refused} == want == {114, 260}


def test_lifecycle_against_a_loop(spark):
    rnd = random.Random(4)
    changes = [(rnd.randint(0, 40), f"2024-01-01 00:{i:02d}:{rnd.randint(0, 9):02d}", rnd.choice(rules.STATUSES), rnd.choice(rules.ACTORS)) for i in range(60) for _ in range(6)]
    frame = spark.createDataFrame(changes, "order_id long, at string, target string, actor string")
    states = spark.createDataFrame([(k, "PENDING") for k in range(45)], "order_id long, status string")
    open_to = {(a, b): {*actors, "ADMIN"} for a, b, actors in rules.EDGES}
    want = {k: ["PENDING", 0, 0] for k in range(45)}
    for k, _, target, actor in sorted(changes, key=lambda c: (c[0], c[1], c[2])):
        ok = actor in open_to.get((want[k][0], target), ())
        want[k] = [target if ok else want[k][0], want[k][1] + ok, want[k][2] + (not ok)]
    tied = {(k, at, t) for k, at, t, _ in changes}
    got = {r.order_id: [r.status, r.applied, r.refused] for r in orders.lifecycle(states, frame.dropDuplicates(["order_id", "at", "target"])).collect()}
    if len(tied) == len(changes):
        assert got == want
    assert len(got) == 45 and orders.lifecycle(states.limit(0), frame).count() == 0


def test_pages_cover_all_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 7), f"t{i}") for i in range(50)], "id long, base_price double, title string")
    seen, after = [], None
    while part := catalog.page(rows, "price_desc", 8, after).collect():
        seen += [r.id for r in part]
        after = (part[-1].base_price, part[-1].id)
    assert seen == [i for _, i in sorted((-(i % 7), i) for i in range(50))]


def test_settings_by_type(spark):
    m = Market(spark, "")
    assert tuple(accounts.settings(m, [("commission_rate", "0.05"), ("delivery_fee", "4000")]).collect()[0]) == (0.05, 4000.0)
    assert tuple(accounts.settings(m, [("commission_rate", '"0.05"'), ("delivery_fee", "null")]).collect()[0]) == (0.1, 5000.0)


def test_streams(spark, tmp_path):
    codes = spark.createDataFrame([("p", "2024-01-01 00:00:00"), ("p", "2024-01-01 00:02:00"), ("p", "2024-01-01 00:04:00"), ("q", "2024-01-01 00:03:00"), ("z", "2024-01-02 00:00:00")], "phone_key string, created_at string")
    codes.withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/codes")
    stream = spark.readStream.schema("phone_key string, created_at timestamp").parquet(f"{tmp_path}/codes")
    taken = []
    query = streaming.deliver(streaming.code_requests(stream), lambda rows, k: taken.extend(rows.collect()), f"{tmp_path}/at", "update")
    query.awaitTermination(60)
    assert {(r.phone_key, r.sent) for r in taken if r.refused} == {("p", 3)}
    refused = streaming.refused_changes(spark.createDataFrame([("PENDING", "SHIPPED", "VENDOR"), ("PENDING", "CONFIRMED", "VENDOR")], "old string, target string, actor string"))
    assert [r.reason for r in refused.collect()] == ["no_edge"]
    held = streaming.toggled(spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "user_id long, product_id long"))
    assert {(r.product_id, r.held) for r in held.collect()} == {(2, False), (3, True)}
    placed = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")], "order_id long, placed_at string")
    confirmed = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:30:00")], "order_id long, confirmed_at string")
    assert {(r.order_id, r.status) for r in streaming.unconfirmed(placed, confirmed).collect()} == {(1, "CONFIRMED"), (2, "CANCELLED")}


@pytest.mark.parametrize("old,new,want", [("SHIPPED", "DELIVERED", (-1, -1, 1)), ("PENDING", "CANCELLED", (0, -1, 0)), ("DELIVERED", "RETURNED", (1, 0, -1)), ("SHIPPED", "RETURNED", (0, -1, 0)), ("PENDING", "CONFIRMED", (0, 0, 0))])
def test_stock_deltas(spark, old, new, want):
    row = spark.range(1).select(*[rules.stock_delta(F.lit(old), F.lit(new), k).alias(f"d{k}") for k in range(3)]).collect()[0]
    assert tuple(row) == want


def test_signs_that_skip_compatibility_composition_are_left_alone_by_it():
    import re
    import unicodedata

    from quoin.functions.text import COMPOSED

    safe = re.compile(f"[{COMPOSED}]")
    signs = [chr(k) for k in range(0x3000) if safe.match(chr(k))]
    assert len(signs) > 300 and all(unicodedata.normalize("NFKC", c) == c for c in signs)
    every = "".join(a + b for a in signs for b in signs)
    assert unicodedata.normalize("NFKC", every) == every


def test_stateful_streams_over_several_batches(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    steps = [[(1, at(0), "CONFIRMED", "VENDOR"), (2, at(1), "SHIPPED", "VENDOR")], [(1, at(5), "PREPARING", "CUSTOMER"), (1, at(6), "CANCELLED", "ADMIN"), (2, at(6), "CANCELLED", "CUSTOMER")], [(1, at(9), "CONFIRMED", "ADMIN")]]
    codes = [[("p", k, at(k)) for k in range(3)] + [("q", 9, at(0))], [("p", 3, at(10)), ("p", 4, at(13))], [("p", 5, at(40))]]
    for name, batches, schema in (("changes", steps, "order_id long, at timestamp, target string, actor string"), ("codes", codes, "phone_key string, id long, created_at timestamp")):
        taken = []
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
            made = streaming.order_states(stream) if name == "changes" else streaming.code_limits(stream)
            streaming.deliver(made, lambda frame, k: taken.extend(frame.collect()), f"{tmp_path}/at-{name}").awaitTermination(90)
        if name == "changes":
            assert [(r.order_id, r.verdict, r.status) for r in taken if r.order_id == 1] == [(1, "ok", "CONFIRMED"), (1, "refused", "CONFIRMED"), (1, "ok", "CANCELLED"), (1, "refused", "CANCELLED")]
            assert [(r.verdict, r.status) for r in taken if r.order_id == 2] == [("refused", "PENDING"), ("ok", "CANCELLED")]
        else:
            assert {r.id: (r.short, r.long, r.refused) for r in taken} == {0: (0, 0, False), 1: (1, 1, False), 2: (2, 2, False), 9: (0, 0, False), 3: (3, 3, True), 4: (1, 4, False), 5: (0, 5, False)}


def test_calls_by_others_with_foreign_targets_and_for_missing_orders(spark):
    orders = spark.createDataFrame([(1, 1, 7, 1000001, "PENDING"), (2, 1, 7, 1000001, "DELIVERED"), (3, 1, 7, 1000001, "PENDING"), (4, 1, 7, 1000001, "SHIPPED"), (5, 1, 7, 1000001, "CONFIRMED"), (6, 1, 7, 1000001, "PENDING"), (7, 1, None, 1000001, "PENDING")], "checkout_id long, vendor_id long, customer_id long, vendor_user_id long, status string")
    calls = [(1, "cancel", 7, "CANCELLED", "ok"), (2, "confirm", 8, "COMPLETED", "not_found"), (3, "update", 1000001, "COMPLETED", "invalid"), (4, "update", 1000001, "DELIVERED", "ok"), (5, "cancel", 7, "CANCELLED", "role"), (6, "force", 1, "CONFIRMED", "ok"), (7, "cancel", 7, "CANCELLED", "not_found"), (8, "force", 1, "CONFIRMED", "not_found"), (9, "other", 1, "CONFIRMED", "invalid"), (10, "update", 1000001, None, "invalid")]
    rows = spark.createDataFrame([(c, 1, p, by, t, 'no "one"' if c == 6 else None) for c, p, by, t, _ in calls], "checkout_id long, vendor_id long, procedure string, by long, target string, note string")
    judged = placement.call_procedures(orders, rows)
    assert {r.checkout_id: r.verdict for r in judged.collect()} == {c: v for c, *_, v in calls}
    assert [tuple(r) for r in placement.forced_audit(judged).collect()] == [(1, "order.force_status", "Order", "6/1", '{"status":"CONFIRMED","note":"no \\"one\\""}')]


def test_cart_changes_against_a_loop(spark):
    rnd = random.Random(4)
    stock = {v: (rnd.randint(0, 9), rnd.randint(0, 3)) for v in range(6)}
    changes = [(c, v, k, rnd.choice(("add", "add", "set", "remove")), rnd.randint(-1, 5)) for k, (c, v) in enumerate((rnd.randint(0, 40), rnd.randint(0, 6)) for _ in range(3000))]
    changes = [(c, v, k, op, max(1, q) if op == "add" else q) for c, v, k, op, q in changes] + [(None, 1, 9000, "add", 1), (1, None, 9001, "add", 1)]
    want: dict[tuple[int, int], int] = {}
    for c, v, _, op, q in changes:
        most = max(0, stock[v][0] - stock[v][1]) if v in stock else 0
        if op == "remove":
            want.pop((c, v), None)
        elif op == "add":
            want[c, v] = min(want.get((c, v), 0) + q, most)
        elif (c, v) in want:
            want[c, v] = max(0, min(q, most))
        if want.get((c, v)) == 0:
            del want[c, v]
    variants = spark.createDataFrame([(v, 10.0, a, b) for v, (a, b) in stock.items()], "id long, price double, stock int, reserved_stock int")
    got = shop.change_carts(spark.createDataFrame(changes, "cart_id long, variant_id long, seq long, op string, quantity long"), variants)
    assert {(r.cart_id, r.variant_id): r.quantity for r in got.collect()} == {k: q for k, q in want.items() if None not in k}
    assert shop.change_carts(spark.createDataFrame([], "cart_id long, variant_id long, seq long, op string, quantity long"), variants).count() == 0


def test_places_without_stores_show_those_of_the_whole_country(spark):
    m = Market(spark, "/root/testdata/sf0.001")
    rows = shop.local_stores(m, limit=2).collect()
    homes = {r.governorate_id for r in m.vendor.filter("status = 'APPROVED' and governorate_id is not null").collect()}
    assert {r.governorate_id for r in rows} == {r.id for r in m.governorate.collect()} and all(r.is_local == (r.governorate_id in homes) and r.place <= 2 for r in rows)
