"""The marketplace's tables as DataFrames over the raw Parquet tables.

Attributes that the raw data lack (statuses, overrides, stock) are functions of the keys. Every table is a declarative plan,
so a query reads only the columns and rows that it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY, RATE = "decimal(12,2)", "decimal(5,4)"
#: Order lines that one task sorts or groups at a time, whatever the size of the tables.
TASK_LINES = 200_000
DELIVERY_FEE, PLATFORM_RATE = 5000, "0.1000"


def _cases(key: Column, values: dict[int, str | None], default: str | None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(F.lit(default))


#: The way to each state, by the legal changes.
_TO_DELIVERED = ("PENDING", "CONFIRMED", "PREPARING", "SHIPPED", "DELIVERED")
PATHS = {s: _TO_DELIVERED[: k + 1] for k, s in enumerate(_TO_DELIVERED)} | {"COMPLETED": (*_TO_DELIVERED, "COMPLETED"), "RETURNED": (*_TO_DELIVERED, "RETURNED"), "CANCELLED": ("PENDING", "CANCELLED")}


def commission_amount(subtotal: Column, rate: Column) -> Column:
    """The platform's share, rounded half up to whole units."""
    return F.floor(subtotal * rate + F.lit("0.5").cast("decimal(2,1)")).cast(MONEY)


class Market:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _rows(self, name: str) -> Column:
        """The number of a raw table's rows, as a scalar subquery."""
        return self.raw(name).agg(F.count("*")).scalar()

    @cached_property
    def parts(self) -> int:
        """How many tasks the order lines are dealt to; the files' footers tell how many lines there are."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.raw("lineitem").count() // TASK_LINES))

    def dealt(self, rows: DataFrame, by: str) -> DataFrame:
        """rows dealt by a key with few lines each, a checkout or an order. Grouping and joining by that key, alone or with others, move them no more."""
        return rows.repartition(self.parts, by)

    @cached_property
    def governorate(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name_ar"), F.upper(F.substring("r_name", 1, 3)).alias("code"), F.col("r_regionkey").alias("sort_order"))

    @cached_property
    def area(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name_ar"), F.col("n_regionkey").alias("governorate_id"))

    @cached_property
    def app_user(self) -> DataFrame:
        phone = lambda head, key: F.concat(F.lit(head), F.lpad(F.col(key).cast("string"), 8, "0"))
        buyers = self.raw("customer").select(F.col("c_custkey").alias("id"), phone("+96470", "c_custkey").alias("phone"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("name"), F.lit("CUSTOMER").alias("role"), (F.col("c_custkey") % 50 == 7).alias("is_blocked"))
        sellers = self.raw("supplier").select((F.col("s_suppkey") + 1000000).alias("id"), phone("+96471", "s_suppkey").alias("phone"), F.col("s_name").alias("name"), F.lit("VENDOR").alias("role"), F.lit(False).alias("is_blocked"))
        return buyers.unionByName(sellers)

    @cached_property
    def vendor(self) -> DataFrame:
        key = F.col("s_suppkey")
        rate = F.when(key % 25 == 0, F.lit("0.0000")).when(key % 5 == 0, F.lit("0.0700")).cast(RATE)
        return (
            self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(key.alias("id"), (key + 1000000).alias("user_id"), F.col("s_name").alias("store_name"), _cases(key % 10, {7: "PENDING", 8: "SUSPENDED", 9: "REJECTED"}, "APPROVED").alias("status"), rate.alias("commission_rate"), F.when(key % 20 != 3, F.col("n_regionkey")).alias("governorate_id"))
        )

    @cached_property
    def category(self) -> DataFrame:
        part = self.raw("part")
        roots = part.select(F.col("p_type").alias("id"), F.col("p_type").alias("name_ar"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("is_active")).distinct()
        leaves = part.select(F.concat_ws("/", "p_type", "p_brand").alias("id"), F.col("p_brand").alias("name_ar"), F.col("p_type").alias("parent_id"), (F.col("p_brand") != "Brand#13").alias("is_active")).distinct()
        return roots.unionByName(leaves)

    @cached_property
    def product(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("id"), (key % self._rows("supplier")).alias("vendor_id"), F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")).alias("category_id"), F.col("p_name").alias("title"), F.lower("p_name").alias("title_norm"), F.col("p_retailprice").cast(MONEY).alias("base_price"),
            _cases(key % 10, {0: "DRAFT", 1: "PENDING_REVIEW", 2: "REJECTED", 3: "ARCHIVED"}, "ACTIVE").alias("status"),
        )

    @cached_property
    def product_variant(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        rows = self.raw("part").select("*", F.explode(F.sequence(F.lit(0), size % 3)).alias("k"))
        k = F.col("k")
        return rows.select((key * 10 + k).alias("id"), key.alias("product_id"), (F.col("p_retailprice").cast(MONEY) + k * 10).cast("decimal(13,2)").alias("price"), (size * 10 + k).cast("int").alias("stock"), ((size * 3 + k * 7) % 40).cast("int").alias("reserved_stock"), (~((k == 2) & (key % 4 == 0))).alias("is_active"))

    @cached_property
    def product_image(self) -> DataFrame:
        """Up to three images of each product, by its size."""
        rows = self.raw("part").select("p_partkey", F.posexplode(F.filter(F.sequence(F.lit(-1), F.col("p_size") % 4 - 1), lambda k: k >= 0)).alias("sort_order", "k"))
        return rows.select((F.col("p_partkey") * 10 + F.col("k")).alias("id"), F.col("p_partkey").alias("product_id"), "sort_order", F.concat(F.lit("/img/"), F.col("p_partkey"), F.lit("/"), F.col("k"), F.lit(".jpg")).alias("url"))

    @cached_property
    def order_item(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("checkout_id"), (F.col("l_partkey") % self._rows("supplier")).alias("vendor_id"), F.col("l_partkey").alias("product_id"), (F.col("l_partkey") * 10).alias("variant_id"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("line_total"), "l_shipdate")

    @cached_property
    def checkout(self) -> DataFrame:
        """What all of a checkout's orders have in common; no line items are read."""
        key = F.col("o_orderkey")
        status = (
            F.when(F.col("o_orderstatus") == "O", _cases(key % 4, {0: "PENDING", 1: "CONFIRMED", 2: "PREPARING"}, "SHIPPED"))
            .when(F.col("o_orderstatus") == "F", _cases(key % 2, {0: "DELIVERED"}, "COMPLETED"))
            .otherwise(_cases(key % 3, {0: "CANCELLED", 1: "RETURNED"}, "COMPLETED"))
        )
        return self.raw("orders").select(key.alias("checkout_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("placed_at"), status.alias("status"))

    @cached_property
    def status_history(self) -> DataFrame:
        """The states that a checkout's orders went through, one a day from placing on: (checkout_id, status, at)."""
        path = F.create_map(*[F.lit(x) for status, states in PATHS.items() for x in (status, ",".join(states))])[F.col("status")]
        rows = self.checkout.select("checkout_id", "placed_at", F.posexplode(F.split(path, ",")).alias("k", "status"))
        return rows.select("checkout_id", "status", (F.col("placed_at").cast("timestamp") + F.make_dt_interval(days="k")).alias("at"))

    @cached_property
    def vendor_order(self) -> DataFrame:
        """One row for each vendor of each checkout. Lines and checkouts move once, by checkout."""
        items = self.dealt(self.order_item.select("checkout_id", "vendor_id", "line_total"), "checkout_id").groupBy("checkout_id", "vendor_id").agg(F.sum("line_total").alias("subtotal"), F.count("*").alias("item_count"))
        return items.join(self.dealt(self.checkout, "checkout_id"), "checkout_id").select("checkout_id", "vendor_id", "customer_id", "placed_at", "status", "subtotal", F.lit(DELIVERY_FEE).cast(MONEY).alias("delivery_fee"), "item_count")

    @cached_property
    def commission(self) -> DataFrame:
        vendors = self.vendor.select(F.col("id").alias("vendor_id"), F.coalesce("commission_rate", F.lit(PLATFORM_RATE).cast(RATE)).alias("rate"))
        return self.vendor_order.join(vendors, "vendor_id").select("checkout_id", "vendor_id", "rate", commission_amount(F.col("subtotal"), F.col("rate")).alias("amount"), F.when(F.col("checkout_id") % 3 == 0, F.col("vendor_id") * 1000).alias("payout_id"), "subtotal", "delivery_fee", "status", "placed_at")

    def _events(self, kind: str) -> DataFrame:
        return self.raw("events").filter(F.col("event_type") == kind)

    @cached_property
    def review(self) -> DataFrame:
        key = F.col("event_id")
        return self._events("purchase").select(key.alias("id"), "user_id", (key % self._rows("part")).alias("product_id"), (key % 5 + 1).cast("int").alias("rating"), F.when(key % 7 == 0, "PENDING").otherwise("PUBLISHED").alias("status"), F.col("ts").alias("created_at"))

    @cached_property
    def favorite_toggle(self) -> DataFrame:
        return self._events("view").select("user_id", (F.col("event_id") % 50).alias("product_id"), "ts")

    @cached_property
    def notification(self) -> DataFrame:
        return self._events("click").select(F.col("event_id").alias("id"), "user_id", F.lit("order.status_changed").alias("type"), F.col("props").alias("data"), F.when(F.col("value") < 50, F.col("ts")).alias("read_at"), F.col("ts").alias("created_at"))

    @cached_property
    def otp_code(self) -> DataFrame:
        return self._events("signup").select(F.col("event_id").alias("id"), F.col("user_id").alias("phone_key"), F.col("ts").alias("created_at"))

    @cached_property
    def audit_log(self) -> DataFrame:
        return self._events("error").select(F.col("event_id").alias("id"), F.col("user_id").alias("actor_id"), F.lit("event.error").alias("action"), F.col("ts").alias("created_at"))
