"""A sweep and the reads after it over one version of the tables.

The sweep writes the tables that it changes; only when all are written does it return a market whose reads take these
stored tables, whatever happens to the live ones meanwhile. A sweep that fails returns nothing, and the market as it was stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import rules
from quoin.operators.orders import AS_OF, expired, stamp
from quoin.sources.market import Market
from quoin.sources.stored import store


class Swept(Market):
    """A market after its lapsed orders were cancelled: ``released`` has the cancelled checkouts; checkout, product_variant and what
    is made of them come from the sweep's tables."""

    def __init__(self, live: Market, checkout: DataFrame, product_variant: DataFrame, released: DataFrame):
        super().__init__(live.spark, live.sf_dir)
        self.released = released
        self.__dict__ |= {"checkout": checkout, "product_variant": product_variant}  # in place of the cached ones


def sweep(m: Market, as_of: str = AS_OF) -> Swept:
    """Cancels all pending orders whose reservation has lapsed at as_of, the bound included, and frees what they reserved."""
    released = store(expired(m.checkout, as_of).select("checkout_id", "expires_at"), "released")
    status = F.when(F.col("gone"), "CANCELLED").otherwise(F.col("status")).alias("status")
    marks = released.select("checkout_id", F.lit(True).alias("gone"))
    checkout = store(m.checkout.join(marks, "checkout_id", "left").select(*[status if c == "status" else F.col(c) for c in m.checkout.columns]), "checkout")
    units = m.order_item.join(released, "checkout_id", "left_semi").groupBy(F.col("variant_id").alias("id")).agg(F.sum("quantity").cast("int").alias("units"))
    freed = (F.col("reserved_stock") - F.coalesce("units", F.lit(0))).alias("reserved_stock")
    variants = store(m.product_variant.join(units, "id", "left").select(*[freed if c == "reserved_stock" else F.col(c) for c in m.product_variant.columns]), "product_variant")
    return Swept(m, checkout, variants, released)


def my_orders(m: Market, limit: int = 20, after: DataFrame | None = None) -> DataFrame:
    """Each customer's newest orders as their list shows them: items, the title of the first by id, and whether there are more after
    the page. ``after`` (customer_id, placed_at, checkout_id, vendor_id) has the last order that each customer has seen; customers
    without one begin at the newest."""
    lines = m.order_item.join(m.product.select(F.col("id").alias("product_id"), "title"), "product_id", "left")
    orders = lines.groupBy("checkout_id", "vendor_id").agg(F.sum("line_total").alias("subtotal"), F.count("*").alias("item_count"), F.coalesce(F.min_by("title", "product_id"), F.lit("")).alias("first_item")).join(m.checkout, "checkout_id")
    if after is not None:
        seen = after.select("customer_id", F.struct((-F.unix_micros(F.col("placed_at").cast("timestamp"))).alias("t"), "checkout_id", "vendor_id").alias("seen"))
        key = F.struct((-F.unix_micros(F.col("placed_at").cast("timestamp"))).alias("t"), "checkout_id", "vendor_id")
        orders = orders.join(seen, "customer_id", "left").filter(F.col("seen").isNull() | (key > F.col("seen"))).drop("seen")
    newest = Window.partitionBy("customer_id").orderBy(F.desc("placed_at"), "checkout_id", "vendor_id")
    ahead = orders.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit + 1)  # one more than a page
    page = ahead.withColumn("has_next", F.max("place").over(Window.partitionBy("customer_id")) > limit).filter(F.col("place") <= limit)
    stores = m.vendor.select(F.col("id").alias("vendor_id"), "store_name")
    total = F.col("subtotal") + F.lit(5000)
    return page.join(stores, "vendor_id", "left").select("customer_id", "place", "checkout_id", "vendor_id", "store_name", "status", "item_count", "first_item", stamp("placed_at"), total.cast("double").alias("total"), "has_next")


def my_orders_swept(m: Market) -> DataFrame:
    return my_orders(sweep(m), limit=5)


def my_orders_next(m: Market) -> DataFrame:
    """The second page of every customer who has one."""
    swept = sweep(m)
    first = my_orders(swept, limit=5).filter("place = 5")
    return my_orders(swept, limit=5, after=first.withColumn("placed_at", F.col("placed_at").cast("timestamp_ntz"))).join(first.select("customer_id"), "customer_id", "left_semi")


def dashboard(m: Market) -> DataFrame:
    """The platform's figures in one row, all over one sweep's tables; statuses are counted as status:count by name."""
    swept = sweep(m)

    def by_status(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("status").agg(F.count("*").alias("n"))
        return counts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws(":", x["status"], x["n"].cast("string"))), ",").alias(name))

    done = F.col("status").isin(*rules.REALISED)
    money = swept.commission.agg(F.coalesce(F.sum(F.when(done, F.col("subtotal") + F.col("delivery_fee"))), F.lit(0)).cast("double").alias("gmv"), F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0)).cast("double").alias("commission_revenue"), F.count_if(done).alias("realized_orders"))
    parts = [swept.app_user.agg(F.count("*").alias("users")), by_status(swept.vendor, "vendors"), by_status(swept.product, "products"), by_status(swept.vendor_order, "orders"), swept.vendor.agg(F.count_if(F.col("status") == "PENDING").alias("pending_vendors")), swept.product.agg(F.count_if(F.col("status") == "PENDING_REVIEW").alias("pending_products"))]
    for part in parts:  # one row each
        money = money.join(F.broadcast(part))
    return money
