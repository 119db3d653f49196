"""Decisions on vendors and products, and products created and edited by vendors, with the notices and audit entries they emit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import text
from quoin.sources.market import Market

# Titles of the notices by decision.
VENDOR_TITLES = {"APPROVED": "تم اعتماد متجرك", "REJECTED": "تم رفض طلب المتجر", "SUSPENDED": "تم تعليق متجرك"}
PRODUCT_TITLES = {"ACTIVE": "تم نشر منتجك", "REJECTED": "تم رفض منتجك"}


def _pick(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def status_json(status: Column) -> Column:
    return F.concat(F.lit('{"status":"'), status, F.lit('"}'))


def audit(rows: DataFrame, entity_type: str, action: Column, before: Column, after: Column, *more: Column) -> DataFrame:
    """Audit entries for rows (id, actor_id)."""
    return rows.select("id", "actor_id", F.lit(entity_type).alias("entity_type"), action.alias("action"), before.alias("before"), after.alias("after"), *more)


def review_vendors(vendors: DataFrame, decisions: DataFrame) -> DataFrame:
    """vendors (id, user_id, status) after decisions (id, decision, note, actor_id): audit entry, note kept on a rejected vendor, and
    the notice. Decisions on vendors that aren't there have no effect."""
    d = F.col("decision")
    return audit(vendors.join(decisions, "id"), "VendorProfile", F.concat(F.lit("vendor."), F.lower(d)), status_json(F.col("status")), status_json(d), d.alias("status"), F.when(d == "REJECTED", F.col("note")).alias("rejection_note"), F.col("user_id").alias("notified"), _pick(VENDOR_TITLES, d).alias("title"), F.col("note").alias("body"))


def vendor_decisions(m: Market) -> DataFrame:
    """Pending vendors and every sixth are decided on by their keys."""
    key = F.col("id")
    decided = m.vendor.filter((F.col("status") == "PENDING") | (key % 6 == 2))
    batch = decided.select("id", F.element_at(F.array(*map(F.lit, VENDOR_TITLES)), (key % 3 + 1).cast("int")).alias("decision"), F.when(key % 4 != 1, F.concat(F.lit("note "), key.cast("string"))).alias("note"), F.lit(1).alias("actor_id"))
    return review_vendors(m.vendor, batch)


def review_products(products: DataFrame, vendors: DataFrame, decisions: DataFrame) -> DataFrame:
    """products (id, vendor_id, title, status) after decisions (id, decision: ACTIVE or REJECTED, note, actor_id)."""
    d = F.col("decision")
    rows = products.join(decisions, "id").join(vendors.select(F.col("id").alias("vendor_id"), "user_id"), "vendor_id")
    # Fixed value: the text of the notice.
    body = F.when(d == "REJECTED", F.col("note")).otherwise(F.concat(F.lit("«"), F.col("title"), F.lit("» أصبح منشوراً.")))
    action = F.when(d == "ACTIVE", "product.approve").otherwise("product.reject")
    return audit(rows, "Product", action, status_json(F.col("status")), status_json(d), d.alias("status"), F.col("user_id").alias("notified"), _pick(PRODUCT_TITLES, d).alias("title"), body.alias("body"))


def product_decisions(m: Market) -> DataFrame:
    """All products under review are decided on by their keys."""
    key = F.col("id")
    batch = m.product.filter("status = 'PENDING_REVIEW'").select("id", F.when(key % 3 == 0, "REJECTED").otherwise("ACTIVE").alias("decision"), F.concat(F.lit("note "), key.cast("string")).alias("note"), F.lit(1).alias("actor_id"))
    return review_products(m.product, m.vendor, batch)


def create_products(requests: DataFrame, vendors: DataFrame) -> DataFrame:
    """Drafts from requests (key, user_id, category_id, title, base_price, suffix): only approved vendors' users may create. The slug is
    the title's with the suffix."""
    owners = vendors.filter("status = 'APPROVED'").select("user_id", F.col("id").alias("vendor_id"))
    slug = F.concat_ws("-", text.slugify(F.col("title")), "suffix")
    return requests.join(owners, "user_id").select("key", "vendor_id", "category_id", "title", text.normalize_arabic(F.col("title")).alias("title_norm"), slug.alias("slug"), "base_price", F.lit("DRAFT").alias("status"))


def product_create(m: Market) -> DataFrame:
    """Each vendor's user sends in a copy of the vendor's products of every ninth key."""
    p = m.product.filter("id % 9 = 4").select(F.col("id").alias("key"), (F.col("vendor_id") + 1000000).alias("user_id"), "category_id", F.concat(F.lit("New "), F.col("title")).alias("title"), F.col("base_price").cast("double").alias("base_price"), F.lpad(F.conv(F.col("id").cast("string"), 10, 36), 5, "0").alias("suffix"))
    return create_products(p.withColumn("suffix", F.lower("suffix")), m.vendor)


def update_products(products: DataFrame, changes: DataFrame, vendors: DataFrame) -> DataFrame:
    """products (id, vendor_id, category_id, title, title_norm, base_price, status) after changes (id, user_id, new_title, new_category, new_price) by
    their own vendors: nulls keep the old value, and any change sends an active product back to review."""
    owners = vendors.select(F.col("id").alias("vendor_id"), "user_id")
    asked = F.coalesce("asked", F.lit(False))
    rows = products.join(owners, "vendor_id", "left").join(changes.withColumn("asked", F.lit(True)), ["id", "user_id"], "left")
    title_norm = F.when(F.col("new_title").isNotNull(), text.normalize_arabic(F.col("new_title"))).otherwise(F.col("title_norm"))
    return rows.select(
        "id", "vendor_id", F.coalesce("new_category", "category_id").alias("category_id"), F.coalesce("new_title", "title").alias("title"), title_norm.alias("title_norm"), F.coalesce("new_price", "base_price").cast("double").alias("base_price"),
        F.when(asked & (F.col("status") == "ACTIVE"), "PENDING_REVIEW").otherwise(F.col("status")).alias("status"),
    )


def product_update(m: Market) -> DataFrame:
    """Every eighth product is changed; every third of the requests comes from another vendor's user and has no effect."""
    key = F.col("id")
    user = F.col("vendor_id") + 1000000 + F.when(key % 3 == 0, 1).otherwise(0)
    changes = m.product.filter("id % 8 = 5").select("id", user.alias("user_id"), F.when(key % 2 == 1, F.concat(F.lit("Edited "), F.col("title"))).alias("new_title"), F.lit(None).cast("string").alias("new_category"), F.when(key % 5 == 0, F.lit(999)).cast("decimal(12,2)").alias("new_price"))
    return update_products(m.product, changes, m.vendor)
