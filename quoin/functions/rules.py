"""Order, commission and stock rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The order state machine's edges with the actors that may take them, its final states, and labels.
EDGES = [
    ("PENDING", "CONFIRMED", ["VENDOR"]), ("PENDING", "CANCELLED", ["CUSTOMER", "VENDOR", "SYSTEM"]), ("CONFIRMED", "PREPARING", ["VENDOR"]), ("CONFIRMED", "CANCELLED", ["VENDOR"]),
    ("PREPARING", "SHIPPED", ["VENDOR"]), ("PREPARING", "CANCELLED", ["VENDOR"]), ("SHIPPED", "DELIVERED", ["VENDOR", "SYSTEM"]), ("SHIPPED", "RETURNED", ["CUSTOMER", "VENDOR"]),
    ("DELIVERED", "COMPLETED", ["CUSTOMER", "SYSTEM"]), ("DELIVERED", "RETURNED", ["CUSTOMER"]),
]
STATUSES = ["PENDING", "CONFIRMED", "PREPARING", "SHIPPED", "DELIVERED", "COMPLETED", "CANCELLED", "RETURNED"]
FINAL = ["COMPLETED", "CANCELLED", "RETURNED"]
REALISED = ["DELIVERED", "COMPLETED"]
ACTORS = ["CUSTOMER", "VENDOR", "ADMIN", "SYSTEM"]
LABELS = {"PENDING": "بانتظار التأكيد", "CONFIRMED": "تم التأكيد", "PREPARING": "قيد التحضير", "SHIPPED": "تم الشحن", "DELIVERED": "تم التوصيل", "COMPLETED": "مكتمل", "CANCELLED": "ملغى", "RETURNED": "مُرتجع"}
# What a transition does to (stock, reserved, sold) for each unit.
STOCK_DELTAS = [("*", "DELIVERED", -1, -1, 1), ("*", "CANCELLED", 0, -1, 0), ("DELIVERED", "RETURNED", 1, 0, -1), ("SHIPPED", "RETURNED", 0, -1, 0)]


def transition_reason(old: Column, new: Column, actor: Column) -> Column:
    """Null if the actor may take the edge, else the first reason why not: same, terminal, no_edge, role."""
    edge = allowed = F.lit(False)
    for a, b, actors in EDGES:
        here = (old == a) & (new == b)
        edge, allowed = edge | here, allowed | (here & (actor.isin(*actors) | (actor == "ADMIN")))
    return F.when(old == new, "same").when(old.isin(*FINAL), "terminal").when(~edge, "no_edge").when(~allowed, "role")


def allowed_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "old string, new string, actors array<string>")


def stock_delta(old: Column, new: Column, which: int) -> Column:
    """Change per unit of stock (0), reserved (1) or sold (2)."""
    out = F.lit(0)
    for a, b, *deltas in STOCK_DELTAS:
        out = F.when((new == b) & (F.lit(True) if a == "*" else old == a), deltas[which]).otherwise(out)
    return out


def commission_amount(subtotal: Column, rate: Column) -> Column:
    """Half up to whole units; negative subtotals and rates outside 0 to 1 give null."""
    return F.when((subtotal >= 0) & (rate >= 0) & (rate <= 1), F.floor(subtotal * rate + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(12,2)"))


def available(stock: Column, reserved: Column) -> Column:
    return F.greatest(F.lit(0), stock - reserved)


def reservation_check(stock: Column, reserved: Column, quantity: Column) -> Column:
    return F.when(quantity <= 0, "invalid_quantity").when(available(stock, reserved) < quantity, "insufficient").otherwise("ok")


def order_number(at: Column, serial: Column) -> Column:
    """SQ-YYMM-NNNN; longer serials are kept whole."""
    text = serial.cast("string")
    return F.concat(F.lit("SQ-"), F.date_format(at, "yyMM"), F.lit("-"), F.when(F.length(text) >= 4, text).otherwise(F.lpad(text, 4, "0")))


def status_label(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[status]


def has_role(role: Column, wanted: Column) -> Column:
    return (role == "ADMIN") | (role == wanted)


def mean_rating(total: Column, count: Column) -> Column:
    """Mean to two places, half up, by integers: floor((200 * sum + n) / (2 n)) / 100."""
    return (F.floor((total * 200 + count) / (count * 2)) / 100).cast("decimal(3,2)")
