"""Orders, stock and settlement: dashboards, checkout, lifecycle and payouts as set-based transforms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import rules
from quoin.operators.admission import admission
from quoin.operators.catalog import sold_counts
from quoin.sources.market import DELIVERY_FEE, PLATFORM_RATE, RATE, Market, commission_amount


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def settlement_balances(m: Market) -> DataFrame:
    """What each vendor is owed: subtotals less commission of realised orders without a payout."""
    open_rows = m.commission.filter(F.col("payout_id").isNull() & F.col("status").isin(*rules.REALISED))
    sums = open_rows.groupBy("vendor_id").agg(F.sum(F.col("subtotal") - F.col("amount")).alias("balance"), F.count("*").alias("orders"))
    return sums.join(m.vendor.select(F.col("id").alias("vendor_id"), "store_name"), "vendor_id").select("vendor_id", "store_name", F.col("balance").cast("double").alias("balance"), "orders")


def status_counts(m: Market) -> DataFrame:
    of = lambda name, rows: rows.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "status", "n")
    return of("vendor", m.vendor).unionByName(of("product", m.product)).unionByName(of("order", m.vendor_order))


def vendor_status_map(m: Market) -> DataFrame:
    """Each vendor's orders and products by status, as status:count in the order of the statuses' names."""
    def of(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("vendor_id", "status").agg(F.count("*").alias("n")).groupBy("vendor_id").agg(F.sort_array(F.collect_list(F.struct("status", "n"))).alias("c"))
        return counts.select(F.col("vendor_id").alias("id"), F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["status"], x["n"].cast("string"))), ",").alias(name))

    rows = m.vendor.select("id").join(of(m.vendor_order, "orders"), "id", "left").join(of(m.product, "products"), "id", "left")
    return rows.select("id", F.coalesce("orders", F.lit("")).alias("orders"), F.coalesce("products", F.lit("")).alias("products"))


def gmv_summary(m: Market) -> DataFrame:
    done = m.commission.filter(F.col("status").isin(*rules.REALISED))
    return done.agg(F.coalesce(F.sum(F.col("subtotal") + F.col("delivery_fee")), F.lit(0)).cast("double").alias("gmv"), F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("commission_revenue"), F.count("*").alias("realized_orders"))


def vendor_analytics(m: Market) -> DataFrame:
    done = F.col("status").isin(*rules.REALISED)
    sums = m.commission.groupBy("vendor_id").agg(F.sum(F.when(done, F.col("subtotal"))).alias("gross"), F.sum(F.when(done, F.col("amount"))).alias("commission"), F.count_if(done).alias("completed_orders"), F.count_if(F.col("status") == "PENDING").alias("pending_orders"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return sums.select("vendor_id", zero("gross").alias("gross"), zero("commission").alias("commission"), (zero("gross") - zero("commission")).alias("net"), "completed_orders", "pending_orders")


def vendor_top_products(m: Market, limit: int = 5) -> DataFrame:
    best = Window.partitionBy("vendor_id").orderBy(F.desc("sold_count"), "product_id")
    rows = sold_counts(m).join(m.product.select(F.col("id").alias("product_id"), "vendor_id", "title"), "product_id").filter("sold_count > 0")
    return rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).select("vendor_id", "place", "product_id", "title", "sold_count")


def newest_orders(m: Market, by: str, limit: int) -> DataFrame:
    """The newest orders of each ``by``, with the buyer's shown name."""
    newest = Window.partitionBy(by).orderBy(F.desc("placed_at"), "checkout_id", "vendor_id")
    rows = m.vendor_order.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    users = m.app_user.select(F.col("id").alias("customer_id"), "name", "phone")
    return rows.join(users, "customer_id").select("customer_id", "vendor_id", "checkout_id", "place", "status", "item_count", stamp("placed_at"), F.coalesce("name", "phone").alias("buyer"), (F.col("subtotal") + F.col("delivery_fee")).cast("double").alias("total"))


def admin_orders(m: Market, limit: int = 50) -> DataFrame:
    rows = m.vendor_order.orderBy(F.desc("placed_at"), "checkout_id", "vendor_id").limit(limit)
    users = m.app_user.select(F.col("id").alias("customer_id"), "name", "phone")
    stores = m.vendor.select(F.col("id").alias("vendor_id"), "store_name")
    return rows.join(users, "customer_id").join(stores, "vendor_id").select("checkout_id", "vendor_id", "store_name", F.coalesce("name", "phone").alias("buyer"), "status", stamp("placed_at"), (F.col("subtotal") + F.col("delivery_fee")).cast("double").alias("total"))


def order_detail(m: Market) -> DataFrame:
    """Every order with its items as product:quantity in order. Lines are grouped once."""
    of = F.struct("product_id", "quantity", "line_total")
    items = m.order_item.groupBy("checkout_id", "vendor_id").agg(F.sort_array(F.collect_list(of)).alias("i"), F.sum("quantity").alias("units"), F.sum("line_total").alias("subtotal"))
    lines = F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["product_id"].cast("string"), x["quantity"].cast("string"))), ",")
    return items.join(m.checkout, "checkout_id").select("checkout_id", "vendor_id", "customer_id", "status", "units", lines.alias("items"), F.col("subtotal").cast("double").alias("subtotal"))


def order_page(m: Market, customer: int | None = None, vendor: int | None = None) -> DataFrame:
    """Orders in full: items in order, the history of states from the oldest on, fees, commission and what the vendor gets.

    ``customer`` and ``vendor`` keep their own orders only, as their pages must; the conditions reach the scans. Lines move once,
    by checkout: that serves their grouping and both joins. An order without history or whose vendor is gone stays, with
    an empty history and the platform's rate."""
    checkouts = m.checkout if customer is None else m.checkout.filter(F.col("customer_id") == customer)
    lines = m.order_item if vendor is None else m.order_item.filter(F.col("vendor_id") == vendor)
    items = lines.repartition("checkout_id").groupBy("checkout_id", "vendor_id").agg(F.sort_array(F.collect_list(F.struct("product_id", "quantity", "line_total"))).alias("i"), F.sum("line_total").alias("subtotal"))
    past = m.status_history.groupBy("checkout_id").agg(F.sort_array(F.collect_list(F.struct("at", "status"))).alias("h"))
    history = F.array_join(F.transform(F.coalesce("h", F.array()), lambda h: F.concat_ws("@", h["status"], F.date_format(h["at"], "yyyy-MM-dd"))), ",")
    shown = F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["product_id"].cast("string"), x["quantity"].cast("string"))), ",")
    vendors = m.vendor.select(F.col("id").alias("vendor_id"), "store_name", "commission_rate")
    rate = F.coalesce("commission_rate", F.lit(PLATFORM_RATE).cast(RATE))
    amount = commission_amount(F.col("subtotal"), rate)
    rows = items.join(checkouts, "checkout_id").join(past, "checkout_id", "left").join(vendors, "vendor_id", "left")
    return rows.select(
        "checkout_id", "vendor_id", "customer_id", "store_name", "status", shown.alias("items"), history.alias("history"), F.col("subtotal").cast("double").alias("subtotal"), F.lit(DELIVERY_FEE).cast("double").alias("delivery_fee"),
        rate.cast("double").alias("rate"), amount.cast("double").alias("commission"), (F.col("subtotal") - amount).cast("double").alias("net"),
    )


def checkout_split(m: Market) -> DataFrame:
    """Each checkout as its vendors' orders with fees, and the delivery total over its distinct vendors."""
    return m.vendor_order.groupBy("checkout_id").agg(F.count("*").alias("orders"), F.sum("item_count").alias("items"), F.sum("subtotal").cast("double").alias("subtotal"), F.sum("delivery_fee").cast("double").alias("delivery"), F.sum(F.col("subtotal") + F.col("delivery_fee")).cast("double").alias("total"))


def transition_check(m: Market) -> DataFrame:
    """How many orders stand in each state, for every target and actor with the reason for refusal."""
    spark = m.spark
    counts = m.vendor_order.groupBy("status").agg(F.count("*").alias("orders"))
    asked = spark.createDataFrame([(a, b, c) for a in rules.STATUSES for b in rules.STATUSES for c in rules.ACTORS], "status string, target string, actor string")
    return counts.join(asked, "status").select("status", "target", "actor", F.coalesce(rules.transition_reason(F.col("status"), F.col("target"), F.col("actor")), F.lit("ok")).alias("verdict"), "orders")


NEXT = {"PENDING": "CANCELLED", "SHIPPED": "DELIVERED", "DELIVERED": "RETURNED"}


def stock_effects(m: Market) -> DataFrame:
    """Changes by variant if every pending order is cancelled, every shipped one delivered and every delivered one returned."""
    target = F.create_map(*[F.lit(x) for kv in NEXT.items() for x in kv])[F.col("status")]
    moves = m.checkout.filter(F.col("status").isin(*NEXT)).select("checkout_id", "status", target.alias("target"))
    rows = m.order_item.join(moves, "checkout_id")
    change = lambda k: F.sum(F.col("quantity") * rules.stock_delta(F.col("status"), F.col("target"), k))
    return rows.groupBy("variant_id").agg(change(0).alias("stock"), change(1).alias("reserved"), change(2).alias("sold"))


def available_stock(m: Market, quantity: int = 20) -> DataFrame:
    stock, reserved = F.col("stock"), F.col("reserved_stock")
    return m.product_variant.select("id", rules.available(stock, reserved).alias("available"), rules.reservation_check(stock, reserved, F.lit(quantity)).alias("verdict"))


def vendor_inventory(m: Market) -> DataFrame:
    sums = m.product_variant.groupBy(F.col("product_id").alias("id")).agg(F.sum("stock").alias("stock"), F.sum("reserved_stock").alias("reserved"), F.count("*").alias("variants"))
    return m.product.select("id", "vendor_id", "status").join(sums, "id", "left").select("id", "vendor_id", "status", F.coalesce("stock", F.lit(0)).alias("stock"), F.coalesce("reserved", F.lit(0)).alias("reserved"), F.coalesce("variants", F.lit(0)).alias("variants"))


def resolve_variant(m: Market) -> DataFrame:
    """A product's only active variant; null if it has none or several."""
    lists = m.product_variant.filter("is_active").groupBy("product_id").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return m.product.select(F.col("id").alias("product_id")).join(lists, "product_id", "left").select("product_id", F.when(F.col("n") == 1, F.col("first").cast("string")).alias("variant_id"), F.coalesce("n", F.lit(0)).alias("active_variants"))


def commission_calc(m: Market) -> DataFrame:
    return m.commission.select("checkout_id", "vendor_id", F.col("rate").cast("double").alias("rate"), F.col("amount").cast("double").alias("amount"), (F.col("subtotal") - F.col("amount")).cast("double").alias("net"))


def order_numbers(m: Market) -> DataFrame:
    return m.vendor_order.select("checkout_id", "vendor_id", rules.order_number(F.col("placed_at"), F.col("checkout_id")).alias("number"))


def status_labels(m: Market) -> DataFrame:
    return m.vendor_order.groupBy("status").agg(F.count("*").alias("n")).select("status", rules.status_label(F.col("status")).alias("label"), "n")


def expired(orders: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Pending orders whose reservation has lapsed, the bound included; the expiry becomes a column."""
    until = F.col("placed_at") + F.expr(f"interval {minutes} minutes")
    return orders.filter("status = 'PENDING'").withColumn("expires_at", until).filter(F.col("expires_at") <= F.lit(as_of).cast("timestamp_ntz"))


AS_OF = "1998-01-01 00:00:00"


def reservation_expiry(m: Market) -> DataFrame:
    return expired(m.vendor_order, AS_OF).select("checkout_id", "vendor_id", stamp("expires_at"))


def expired_release(m: Market) -> DataFrame:
    """Units that come free by variant when lapsed orders are cancelled."""
    gone = expired(m.checkout, AS_OF).select("checkout_id")
    return m.order_item.join(gone, "checkout_id").groupBy("variant_id").agg(F.sum("quantity").alias("released"), F.count("*").alias("lines"))


def settle_payouts(m: Market) -> DataFrame:
    """One payout for each vendor with something owed: net, period and orders."""
    rows = m.commission.filter(F.col("payout_id").isNull() & F.col("status").isin(*rules.REALISED))
    return rows.groupBy("vendor_id").agg(F.sum(F.col("subtotal") - F.col("amount")).cast("double").alias("amount"), F.date_format(F.min("placed_at"), "yyyy-MM-dd HH:mm:ss").alias("period_start"), F.date_format(F.max("placed_at"), "yyyy-MM-dd HH:mm:ss").alias("period_end"), F.count("*").alias("orders"), F.lit("PAID").alias("status"))


def payout_history(m: Market, limit: int = 50) -> DataFrame:
    rows = m.commission.filter("payout_id is not null").groupBy("payout_id", "vendor_id").agg(F.sum(F.col("subtotal") - F.col("amount")).alias("amount"), F.max("placed_at").alias("period_end"), F.count("*").alias("orders"))
    return rows.orderBy(F.desc("period_end"), "payout_id").limit(limit).select("payout_id", "vendor_id", F.col("amount").cast("double").alias("amount"), stamp("period_end"), "orders")


def admission_fold(m: Market) -> DataFrame:
    requests = m.order_item.join(m.checkout.select("checkout_id", "placed_at"), "checkout_id").select("checkout_id", "variant_id", "placed_at", "quantity")
    stock = m.product_variant.filter("is_active").select(F.col("id").alias("variant_id"), rules.available(F.col("stock"), F.col("reserved_stock")).alias("available"))
    return admission(requests, stock)


def lifecycle(states: DataFrame, changes: DataFrame, tasks: int | None = None) -> DataFrame:
    """States (order_id, status) after changes (order_id, at, target, actor), taken in order of time, target and actor; refused changes
    leave the state. Returns order_id, status, applied and refused. Folded as a stream over sorted rows; both tables move once, by
    order, to so many ``tasks`` (none given: as many as the session shuffles to)."""
    tasks = tasks or int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = states.repartition(tasks, "order_id").join(changes.repartition(tasks, "order_id"), "order_id", "left")
    edges = {(a, b): set(actors) for a, b, actors in rules.EDGES}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def batch_of(done: list[list]) -> pa.RecordBatch:
            ids, statuses, applied, refused = zip(*done, strict=True) if done else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(statuses, pa.string()), pa.array(applied, pa.int32()), pa.array(refused, pa.int32())], names=["order_id", "status", "applied", "refused"])

        for batch in batches:
            done = []
            for order, status, target, actor in zip(*(batch.column(c).to_pylist() for c in ("order_id", "status", "target", "actor")), strict=True):
                if now is None or now[0] != order:
                    if now is not None:
                        done.append(now)
                    now = [order, status, 0, 0]
                if target is not None:
                    actors = edges.get((now[1], target), set())
                    ok = actor in actors or actor == "ADMIN" and bool(actors)
                    now = [order, target if ok else now[1], now[2] + ok, now[3] + (not ok)]
            yield batch_of(done)
        yield batch_of([now] if now is not None else [])

    return rows.select("order_id", "status", "at", "target", "actor").sortWithinPartitions("order_id", "at", "target", "actor").mapInArrow(fold, "order_id long, status string, applied int, refused int")


def lifecycle_fold(m: Market) -> DataFrame:
    """Every checkout from PENDING through a made-up batch of changes: a change for each of its order lines."""
    steps = F.element_at(F.array(*[F.lit(s) for s in ("CONFIRMED", "PREPARING", "SHIPPED", "DELIVERED", "COMPLETED", "CANCELLED")]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    changes = m.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("at"), steps.alias("target"), F.when(F.col("l_linenumber") % 6 == 4, "CUSTOMER").otherwise("VENDOR").alias("actor"))
    return lifecycle(m.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.lit("PENDING").alias("status")), changes, m.parts)
