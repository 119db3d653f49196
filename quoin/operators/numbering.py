"""Order numbers: gapless serials over all orders in the order of their placing, the vendors of a cart as they were first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import rules
from quoin.operators.ranking import with_serials
from quoin.sources.market import Market


def order_serials(m: Market) -> DataFrame:
    """Every order's serial from 1 by time, checkout, first line and vendor, and its number."""
    lines = m.raw("lineitem").select(F.col("l_orderkey").alias("checkout_id"), (F.col("l_partkey") % m.raw("supplier").agg(F.count("*")).scalar()).alias("vendor_id"), F.col("l_linenumber").alias("line"))
    orders = lines.groupBy("checkout_id", "vendor_id").agg(F.min("line").alias("first_line")).join(m.checkout.select("checkout_id", "placed_at"), "checkout_id")
    numbered = with_serials(orders, ["placed_at", "checkout_id", "first_line", "vendor_id"])
    return numbered.select("checkout_id", "vendor_id", "serial", rules.order_number(F.col("placed_at"), F.col("serial")).alias("number"))


def number_orders(orders: DataFrame, already: int | Column = 0) -> DataFrame:
    """New orders (checkout_id, placed_at, place, ...) with serial and number, after the ``already`` orders that there are."""
    numbered = with_serials(orders, ["placed_at", "checkout_id", "place"], base=already)
    return numbered.withColumn("number", rules.order_number(F.col("placed_at"), F.col("serial")))


def orders_so_far(m: Market) -> Column:
    """The number of orders, as a scalar subquery."""
    return m.dealt(m.order_item.select("checkout_id", "vendor_id"), "checkout_id").distinct().agg(F.count("*")).scalar()
