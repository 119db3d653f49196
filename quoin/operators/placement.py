"""Placing orders and changing their status as set-based transforms with all that they emit.

A cart is a checkout's lines. Each is judged on its own against the stock as it stands, as one call would be; who comes first
when many want the same stock is ``orders.admission``. Nothing of a refused cart is emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import rules
from quoin.operators.numbering import number_orders, orders_so_far
from quoin.sources.market import DELIVERY_FEE, MONEY, PLATFORM_RATE, RATE, Market

HOLD_MINUTES = 30
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def offers(variants: DataFrame, products: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row for each product (``of``): its active variants with their available units, its vendor, and whether it is for sale."""
    units = rules.available(F.col("stock"), F.col("reserved_stock")).alias("available")
    active = variants.filter("is_active").groupBy(F.col("product_id").alias("of")).agg(F.collect_list(F.struct("id", "price", units)).alias("active"))
    stores = vendors.select(F.col("id").alias("vendor_id"), F.col("user_id").alias("vendor_user_id"), F.col("status").alias("vendor_status"), F.coalesce("commission_rate", F.lit(PLATFORM_RATE).cast(RATE)).alias("rate"))
    goods = products.select(F.col("id").alias("of"), "vendor_id", "title", F.col("status").alias("product_status")).join(stores, "vendor_id", "left")
    for_sale = F.coalesce((F.col("product_status") == "ACTIVE") & (F.col("vendor_status") == "APPROVED"), F.lit(False))
    return goods.join(active, "of", "full").select("of", "active", "vendor_id", "title", "vendor_user_id", "rate", for_sale.alias("for_sale"))


def judge_carts(lines: DataFrame, variants: DataFrame, products: DataFrame, vendors: DataFrame, tasks: int | None = None) -> DataFrame:
    """lines (checkout_id, line, product_id, asked, quantity, ...) with the variant_id that each stands for and its cart's verdict. A line's
    variant is the one asked for, if it is an active one of the product, or without one the product's only active variant; else
    null. The verdict is the reason of the cart's first line that names no variant ('variant') or isn't for sale ('unavailable'), then
    'stock' if a variant's units don't hold all that the cart asks of it, else 'ok'.

    Lines move twice, by product and by cart, to so many ``tasks`` each (none given: Spark's own number)."""
    deal = lambda df, by: df if tasks is None else df.repartition(tasks, by)
    asked, active = F.col("asked"), F.col("active")
    # A line without product meets no offer.
    rows = deal(lines, "product_id").join(deal(offers(variants, products, vendors), "of"), F.col("product_id") == F.col("of"), "left")
    only = F.when(F.size(active) == 1, F.get(active, F.lit(0)))
    found = F.when(asked.isNull(), only).otherwise(F.get(F.filter(active, lambda v: v["id"] == asked), F.lit(0)))
    rows = rows.withColumn("v", found).select(*lines.columns, F.col("v.id").alias("variant_id"), F.col("v.price").alias("unit_price"), F.col("v.available").alias("available"), "vendor_id", "title", "vendor_user_id", "rate", F.coalesce("for_sale", F.lit(False)).alias("for_sale"))
    reason = F.when(F.col("variant_id").isNull(), "variant").when(~F.col("for_sale"), "unavailable")
    cart, same = Window.partitionBy("checkout_id"), Window.partitionBy("checkout_id", "variant_id")
    rows = deal(rows, "checkout_id").withColumn("short", F.sum("quantity").over(same) > F.col("available"))
    first = F.min(F.when(reason.isNotNull(), F.struct(F.col("line"), reason.alias("reason")))).over(cart)["reason"]
    return rows.withColumn("verdict", F.coalesce(first, F.when(F.coalesce(F.max("short").over(cart), F.lit(False)), "stock"), F.lit("ok"))).drop("short", "for_sale")


def carts(m: Market) -> DataFrame:
    """Every checkout's lines. Some name no variant, some one that the product may not have."""
    part = F.col("l_partkey")
    asked = F.when(part % 5 == 0, None).when(part % 7 == 3, part * 10 + 2).otherwise(part * 10)
    return m.raw("lineitem").select(F.col("l_orderkey").alias("checkout_id"), F.col("l_linenumber").alias("line"), part.alias("product_id"), asked.alias("asked"), F.least(F.col("l_quantity"), F.lit(9)).cast("int").alias("quantity"))


def placed(m: Market) -> DataFrame:
    """All carts judged; what their checkouts add joins where the lines of a cart are together."""
    judged = judge_carts(carts(m), m.product_variant, m.product, m.vendor, m.parts)
    return judged.join(m.dealt(m.checkout.select("checkout_id", "customer_id", "placed_at"), "checkout_id"), "checkout_id")


def place_verdicts(m: Market) -> DataFrame:
    return placed(m).groupBy("checkout_id").agg(F.first("verdict").alias("verdict"), F.count("*").alias("lines"))


def new_orders(lines: DataFrame) -> DataFrame:
    """The orders of judged lines: one for each vendor of an accepted cart, in the order of their first lines."""
    held = lines.filter("verdict = 'ok'").groupBy("checkout_id", "vendor_id").agg(
        F.min("line").alias("first_line"), F.sum(F.col("unit_price") * F.col("quantity")).cast(MONEY).alias("subtotal"), F.count("*").alias("items"),
        *[F.first(c).alias(c) for c in ("customer_id", "placed_at", "vendor_user_id", "rate")],
    )
    order = Window.partitionBy("checkout_id").orderBy("first_line", "vendor_id")
    fee = F.lit(DELIVERY_FEE).cast(MONEY)
    return held.withColumns({"place": F.row_number().over(order), "delivery_fee": fee, "total": F.col("subtotal") + fee, "commission": rules.commission_amount(F.col("subtotal"), F.col("rate")), "status": F.lit("PENDING")})


def place_orders(m: Market) -> DataFrame:
    money = [F.col(c).cast("double").alias(c) for c in ("subtotal", "delivery_fee", "total", "rate", "commission")]
    return new_orders(placed(m)).select("checkout_id", "vendor_id", "customer_id", "place", "status", "items", *money)


def place_items(m: Market) -> DataFrame:
    """The items of new orders with their snapshots, and what each reserves until when."""
    rows = placed(m).filter("verdict = 'ok'")
    until = F.col("placed_at") + F.make_dt_interval(mins=F.lit(HOLD_MINUTES))
    money = [F.col("unit_price").cast("double").alias("unit_price"), (F.col("unit_price") * F.col("quantity")).cast("double").alias("line_total")]
    return rows.select("checkout_id", "vendor_id", "line", "product_id", "variant_id", "title", "quantity", *money, F.lit("ACTIVE").alias("reservation"), stamp(until).alias("expires_at"))


def numbered(m: Market) -> DataFrame:
    """The new orders of all carts with their numbers, which go on from the orders that there are."""
    return number_orders(new_orders(placed(m)), orders_so_far(m))


def place_numbers(m: Market) -> DataFrame:
    return numbered(m).select("checkout_id", "vendor_id", "place", "serial", "number")


def place_notices(m: Market) -> DataFrame:
    """For each new order its first history entry, and the notices to the customer and to the vendor with its number."""
    number = F.col("number")
    entry = lambda kind, user, body: F.struct(F.lit(kind).alias("kind"), user.alias("user_id"), body.alias("body"))
    # The texts of the notices.
    rows = F.array(
        entry("history", F.col("customer_id"), F.lit("PENDING")),
        entry("order.placed", F.col("customer_id"), F.concat(F.lit("طلبك رقم "), number, F.lit(" بانتظار تأكيد البائع."))),
        entry("order.new", F.col("vendor_user_id"), F.concat(F.lit("لديك طلب جديد رقم "), number, F.lit("."))),
    )
    return numbered(m).select("checkout_id", "vendor_id", F.explode(rows).alias("e")).select("checkout_id", "vendor_id", "e.*")


def change_status(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """orders (checkout_id, vendor_id, status, ...) that requests (checkout_id, vendor_id, target, actor, actor_id, note; one each) ask to
    change: verdict ('ok' or why not), status afterwards, and the reason noted on a cancelled order."""
    return judge_requests(orders.join(requests, ["checkout_id", "vendor_id"]))


def judge_requests(rows: DataFrame) -> DataFrame:
    """The same for orders that carry their request."""
    rows = rows.withColumn("verdict", F.coalesce(rules.transition_reason(F.col("status"), F.col("target"), F.col("actor")), F.lit("ok")))
    ok = F.col("verdict") == "ok"
    return rows.withColumns({"after": F.when(ok, F.col("target")).otherwise(F.col("status")), "cancel_reason": F.when(ok & (F.col("target") == "CANCELLED"), F.col("note"))})


# Who may call each procedure, and the states that it may ask for.
PROCEDURES = {
    "cancel": ("CUSTOMER", ("CANCELLED",)), "confirm": ("CUSTOMER", ("COMPLETED",)), "update": ("VENDOR", ("CONFIRMED", "PREPARING", "SHIPPED", "DELIVERED", "CANCELLED")),
    "force": ("ADMIN", ("CONFIRMED", "PREPARING", "SHIPPED", "DELIVERED", "COMPLETED", "CANCELLED", "RETURNED")),
}


def call_procedures(orders: DataFrame, calls: DataFrame) -> DataFrame:
    """calls (checkout_id, vendor_id, procedure, by, target, note; one an order) judged against orders (checkout_id, vendor_id, customer_id,
    vendor_user_id, status). Verdicts in this order: 'invalid' for a target (or procedure) that isn't the procedure's,
    'not_found' for an order that isn't there or is another buyer's or vendor's, those of change_status, 'ok'."""
    return judge_calls(calls.join(orders, ["checkout_id", "vendor_id"], "left"))


def judge_calls(rows: DataFrame) -> DataFrame:
    """The same for calls that carry their order; its status is null if it isn't there."""
    pick = lambda at: F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for p, v in PROCEDURES.items() for x in (p, v[at])])[F.col("procedure")]
    rows = rows.withColumn("actor", pick(0))
    owner = F.when(F.col("actor") == "CUSTOMER", F.col("customer_id")).when(F.col("actor") == "VENDOR", F.col("vendor_user_id")).otherwise(F.col("by"))
    refused = F.when(~F.coalesce(F.array_contains(pick(1), F.col("target")), F.lit(False)), "invalid").when(F.col("status").isNull() | ~owner.eqNullSafe(F.col("by")), "not_found")
    verdict = F.coalesce(refused, rules.transition_reason(F.col("status"), F.col("target"), F.col("actor")), F.lit("ok"))
    return rows.withColumn("verdict", verdict).withColumn("after", F.when(F.col("verdict") == "ok", F.col("target")).otherwise(F.col("status")))


def forced_audit(judged: DataFrame) -> DataFrame:
    """The audit entry of each forced change that was accepted."""
    after = F.to_json(F.struct(F.col("target").alias("status"), "note"))
    entity = F.concat_ws("/", F.col("checkout_id").cast("string"), F.col("vendor_id").cast("string"))
    return judged.filter("verdict = 'ok' and procedure = 'force'").select(F.col("by").alias("actor_id"), F.lit("order.force_status").alias("action"), F.lit("Order").alias("entity_type"), entity.alias("entity_id"), after.alias("after"))


def called(m: Market) -> DataFrame:
    """Every order with a made-up call by its keys: one in six by somebody else, one in eight of the forced ones without a note."""
    key = F.col("checkout_id") + F.col("vendor_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    orders = m.vendor_order.select("checkout_id", "vendor_id", "customer_id", (F.col("vendor_id") + 1000000).alias("vendor_user_id"), "status")
    procedure = pick(tuple(PROCEDURES), F.col("checkout_id"))
    target = F.when(procedure == "cancel", "CANCELLED").when(procedure == "confirm", "COMPLETED").otherwise(pick(rules.STATUSES, key))
    by = F.when(procedure == "force", F.lit(1)).when(procedure == "update", F.col("vendor_user_id")).otherwise(F.col("customer_id")) + F.when((procedure != "force") & (key % 6 == 0), 1).otherwise(0)
    return judge_calls(orders.withColumns({"procedure": procedure, "by": by.cast("long"), "target": target, "note": F.when(key % 8 != 0, F.concat(F.lit("note "), key.cast("string")))}))


def order_calls(m: Market) -> DataFrame:
    return called(m).select("checkout_id", "vendor_id", "procedure", "by", "target", "verdict", "after")


def order_force_audit(m: Market) -> DataFrame:
    return forced_audit(called(m))


def reservation_state(target: Column) -> Column:
    return F.when(target == "DELIVERED", "CONSUMED").when(target.isin("CANCELLED", "RETURNED"), "RELEASED").otherwise("ACTIVE")


def changed(m: Market) -> DataFrame:
    """Every order with a made-up request: target and actor by its keys."""
    key = F.col("checkout_id") + F.col("vendor_id")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    orders = m.vendor_order.select("checkout_id", "vendor_id", "customer_id", "placed_at", "status")
    actor = pick(rules.ACTORS, F.col("checkout_id"))
    actor_id = F.when(actor == "CUSTOMER", F.col("customer_id").cast("string")).when(actor == "VENDOR", (F.col("vendor_id") + 1000000).cast("string")).otherwise(F.lower(actor))
    return judge_requests(orders.withColumns({"target": pick(rules.STATUSES, key), "actor": actor, "actor_id": actor_id, "note": F.concat(F.lit("note "), key.cast("string"))}))


def change_orders(m: Market) -> DataFrame:
    return changed(m).select("checkout_id", "vendor_id", "status", "target", "actor", "verdict", "after", "cancel_reason")


def change_history(m: Market) -> DataFrame:
    """History entries of accepted changes, the notice to the customer, and the state of the order's reservations afterwards."""
    # Fixed value: the text of the notice.
    body = F.concat(F.lit("طلبك "), rules.order_number(F.col("placed_at"), F.col("checkout_id")), F.lit(": "), rules.status_label(F.col("target")), F.lit("."))
    return changed(m).filter("verdict = 'ok'").select("checkout_id", "vendor_id", F.col("status").alias("from_status"), F.col("target").alias("to_status"), F.col("actor_id").alias("changed_by"), "note", F.col("customer_id").alias("notified"), body.alias("body"), reservation_state(F.col("target")).alias("reservations"))


def change_stock(m: Market) -> DataFrame:
    """What accepted changes do to each variant's stock and reserved units and to its product's sold units."""
    moves = changed(m).filter("verdict = 'ok'").filter(F.col("target").isin("DELIVERED", "CANCELLED", "RETURNED")).select("checkout_id", "vendor_id", "status", "target")
    rows = m.order_item.join(moves, ["checkout_id", "vendor_id"])
    by = lambda k: F.sum(F.col("quantity") * rules.stock_delta(F.col("status"), F.col("target"), k))
    return rows.groupBy("product_id", "variant_id").agg(by(0).alias("stock"), by(1).alias("reserved"), by(2).alias("sold"))


def owed(m: Market) -> DataFrame:
    return m.commission.filter(F.col("payout_id").isNull() & F.col("status").isin(*rules.REALISED))


def settle_stamps(m: Market) -> DataFrame:
    """The commissions that a settlement of all vendors binds to the new payouts."""
    return owed(m).select("checkout_id", "vendor_id", F.concat(F.lit("P"), F.col("vendor_id").cast("string")).alias("payout_id"), F.col("amount").cast("double").alias("amount"))


def settle_audit(m: Market) -> DataFrame:
    """The audit entry of each new payout, and whom it is told."""
    sums = owed(m).groupBy("vendor_id").agg(F.sum(F.col("subtotal") - F.col("amount")).alias("net"), F.count("*").alias("n"))
    after = F.concat(F.lit('{"vendorId":'), F.col("vendor_id").cast("string"), F.lit(',"amount":'), F.col("net").cast("decimal(18,2)").cast("string"), F.lit(',"commissions":'), F.col("n").cast("string"), F.lit("}"))
    users = m.vendor.select(F.col("id").alias("vendor_id"), "user_id")
    return sums.join(users, "vendor_id").select(F.concat(F.lit("P"), F.col("vendor_id").cast("string")).alias("entity_id"), F.lit("Payout").alias("entity_type"), F.lit("payout.create").alias("action"), after.alias("after"), F.col("user_id").alias("notified"), F.lit("payout.paid").alias("notice"))
