"""What inputs must hold, as rules by kind of input: one pass tags each row with all rules it breaks, counts them, and writes
accepted and rejected rows apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quoin.functions import rules, text
from quoin.operators.accounts import code_is_valid, image_is_valid
from quoin.operators.ranking import union_all
from quoin.sources.market import Market
from quoin.sources.stored import store

Rules = dict[str, Column]


def trimmed(column: str, least: int, most: int) -> Column:
    """A text of least to most signs without the blanks around it."""
    return F.length(F.trim(column)).between(least, most)


def optional(column: str, holds: Column) -> Column:
    return F.col(column).isNull() | holds


def whole(column: str, least: int, most: int | None = None) -> Column:
    value = F.col(column)
    return (value % 1 == 0) & (value >= least) & (F.lit(True) if most is None else value <= most)


def url_or_empty(column: str) -> Column:
    return F.col(column).rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/]+") | (F.col(column) == "")


def rules_by_kind() -> dict[str, Rules]:
    # Lengths, bounds, patterns and choices of each input.
    return {
        "otp": {"phone": text.normalize_phone(F.col("phone")).isNotNull(), "code": code_is_valid(F.col("code")), "purpose": F.col("purpose").isin("login", "verify")},
        "profile": {"name": trimmed("name", 2, 60), "email": optional("email", (F.col("email") == "") | F.col("email").rlike(r"^[A-Za-z0-9_'+.-]+@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"))},
        "address": {"full_name": trimmed("full_name", 2, 60), "phone": text.normalize_phone(F.col("phone")).isNotNull(), "line": trimmed("line", 3, 200), "area": F.col("area_id").isNotNull(), "governorate": F.col("governorate_id").isNotNull()},
        "vendor": {"store_name": trimmed("store_name", 2, 80), "description": optional("description", trimmed("description", 0, 500)), "governorate": F.col("governorate_id").isNotNull(), "logo": optional("logo", url_or_empty("logo")), "payout_account": optional("payout_account", trimmed("payout_account", 0, 80))},
        "decision": {"decision": F.col("decision").isin("APPROVED", "REJECTED", "SUSPENDED"), "note": optional("note", trimmed("note", 0, 300))},
        "status": {"target": F.col("target").isin("CONFIRMED", "PREPARING", "SHIPPED", "DELIVERED", "CANCELLED"), "note": optional("note", trimmed("note", 0, 200))},
        "category": {"name": trimmed("name_ar", 2, 60), "icon": optional("icon", trimmed("icon", 0, 40)), "sort_order": optional("sort_order", whole("sort_order", 0))},
        "platform": {"commission_rate": optional("commission_rate", F.col("commission_rate").between(0, 1)), "delivery_fee": optional("delivery_fee", whole("delivery_fee", 0, 100_000))},
        "product": {"title": trimmed("title", 3, 120), "category": F.col("category_id").isNotNull(), "price": whole("base_price", 250, 100_000_000), "images": F.size("images") <= 8, "image": F.forall("images", image_is_valid), "variants": F.col("variants") >= 1},
        "variant": {"price": whole("price", 250, 100_000_000), "stock": whole("stock", 0, 1_000_000), "sku": optional("sku", trimmed("sku", 0, 60))},
        "cart": {"quantity": whole("quantity", 1, 99)},
        "order": {"address": F.col("address_id").isNotNull(), "items": F.col("items") >= 1, "note": optional("note", trimmed("note", 0, 300))},
        "review": {"rating": whole("rating", 1, 5), "comment": optional("comment", trimmed("comment", 0, 500))},
        "list": {"limit": whole("page_limit", 1, 50), "phrase": optional("phrase", trimmed("phrase", 0, 80)), "min_price": optional("min_price", whole("min_price", 0)), "sort": F.col("sort").isin("newest", "price_asc", "price_desc", "rating")},
    }


@dataclass
class Validated:
    """accepted and rejected rows (the latter with ``broken``, the rules in their order), and how many rows break each rule."""

    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]
    total: int


def tag(rows: DataFrame, kind: str) -> DataFrame:
    """rows with ``broken``: the names of all rules of the kind that they break, in order; a rule that is null is broken. A column of
    that name is replaced."""
    broken = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(f"{kind}.{name}")) for name, holds in rules_by_kind()[kind].items()]
    return rows.withColumn("broken", F.array_compact(F.array(*broken)))


def validate(rows: DataFrame, kind: str) -> Validated:
    """Reads the rows once: they are tagged, counted as they pass, and written to two folders of one stored table."""
    seen, names = Observation(), list(rules_by_kind()[kind])
    counts = [F.count_if(F.array_contains("broken", f"{kind}.{name}")).alias(name) for name in names]
    counted = tag(rows, kind).observe(seen, F.count(F.lit(1)).alias("total"), *counts)
    stored = store(counted.withColumn("is_accepted", F.size("broken") == 0), f"validated_{kind}", by="is_accepted")
    found = seen.get
    return Validated(stored.filter("is_accepted").select(*rows.columns), stored.filter("not is_accepted").drop("is_accepted"), {f"{kind}.{name}": found[name] for name in names}, found["total"])


def inputs(m: Market) -> dict[str, DataFrame]:
    """Inputs of every kind, made of the tables' rows by their keys; every kind has rows that break rules."""
    null = lambda kind: F.lit(None).cast(kind)
    k = F.col("id")
    user = m.app_user
    place = m.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area_id"))
    images = F.transform(F.filter(F.sequence(F.lit(-1), (k % 10 - 1).cast("int")), lambda i: i >= 0), lambda i: F.concat(F.when(k % 11 == 0, "ftp://x/").otherwise("/img/"), k, F.lit("/"), i))
    variants = m.product_variant.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("variants"))
    return {
        "otp": user.select("id", F.when(k % 13 == 0, F.substring("phone", 1, 9)).otherwise(F.col("phone")).alias("phone"), F.substring(F.concat(F.lit(" "), k * 977, F.lit(" ")), 1, 12).alias("code"), F.when(k % 17 == 0, "other").otherwise("login").alias("purpose")),
        "profile": user.select("id", "name", F.when(k % 3 == 0, F.concat(F.lit("u"), k, F.lit("@example.com"))).when(k % 3 == 1, F.concat(F.lit("u"), k, F.lit("@x"))).alias("email")),
        "address": user.filter("role = 'CUSTOMER'").join(place, "id").select("id", F.col("name").alias("full_name"), "phone", F.repeat(F.lit("x"), (k % 205).cast("int")).alias("line"), F.when(k % 19 != 0, F.col("area_id")).alias("area_id"), F.when(k % 23 != 0, F.col("area_id") % 5).alias("governorate_id")),
        "vendor": m.vendor.select("id", "store_name", F.repeat(F.lit("d"), (k * 37 % 600).cast("int")).alias("description"), "governorate_id", F.when(k % 3 == 0, "").when(k % 3 == 1, "https://x.example/l.png").otherwise("l.png").alias("logo"), null("string").alias("payout_account")),
        "decision": m.vendor.select("id", F.element_at(F.array(*map(F.lit, ("APPROVED", "REJECTED", "SUSPENDED", "PENDING"))), (k % 4 + 1).cast("int")).alias("decision"), F.repeat(F.lit("n"), (k * 7 % 310).cast("int")).alias("note")),
        "status": m.raw("orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, rules.STATUSES)), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("target"), null("string").alias("note")),
        "category": m.category.select("id", "name_ar", F.repeat(F.lit("i"), F.length("id") * 3).alias("icon"), (F.length("id") - 8).alias("sort_order")),
        "platform": m.raw("events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("value") / 80).alias("commission_rate"), F.floor(F.col("value") * 1500).alias("delivery_fee")),
        "product": m.product.join(variants, "id", "left").select("id", "title", "category_id", "base_price", images.alias("images"), F.when(k % 29 != 0, F.col("variants")).otherwise(0).alias("variants")),
        "variant": m.product_variant.select("id", "price", (F.col("stock") - F.when(k % 31 == 0, 1000).otherwise(0)).alias("stock"), F.repeat(F.lit("s"), (k % 70).cast("int")).alias("sku")),
        "cart": m.raw("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 2).alias("quantity")),
        "order": m.raw("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 41 != 0, F.col("o_custkey") * 2).alias("address_id"), (F.col("o_orderkey") % 6).alias("items"), F.repeat(F.lit("n"), (F.col("o_orderkey") % 320).cast("int")).alias("note")),
        "review": m.review.select("id", (F.col("rating") + F.when(k % 9 == 0, 1).otherwise(0)).alias("rating"), F.repeat(F.lit("c"), (k % 520).cast("int")).alias("comment")),
        "list": m.raw("events").filter("event_type = 'view'").select(F.col("event_id").alias("id"), (F.col("event_id") % 55).alias("page_limit"), F.col("props").alias("phrase"), (F.col("value") - 5).alias("min_price"), F.element_at(F.array(F.lit("newest"), F.lit("price_asc"), F.lit("rating"), F.lit("oldest")), (F.col("event_id") % 4 + 1).cast("int")).alias("sort")),
    }


def validation_rejects(m: Market) -> DataFrame:
    """The rejected inputs of every kind with all rules that they break."""
    return union_all([validate(rows, kind).rejected.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.array_join("broken", ",").alias("broken")) for kind, rows in inputs(m).items()])


def validation_report(m: Market) -> DataFrame:
    """How many inputs break each rule, as they were counted while accepted and rejected ones were written."""
    done = [validate(rows, kind) for kind, rows in inputs(m).items()]
    return m.spark.createDataFrame([(rule, n, v.total) for v in done for rule, n in v.counts.items()], "rule_id string, broken long, total long")
