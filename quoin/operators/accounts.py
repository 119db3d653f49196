"""Users, addresses, favourites, reviews, notifications, codes, administration and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import rules, text
from quoin.operators.orders import stamp
from quoin.operators.ranking import running_sums
from quoin.operators.settings import typed
from quoin.sources.market import Market
from quoin.sources.stored import store


def governorate_areas(m: Market) -> DataFrame:
    names = m.area.groupBy(F.col("governorate_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("name_ar")), ",").alias("areas"))
    return m.governorate.join(names, "id", "left").select("id", "name_ar", "code", F.coalesce("areas", F.lit("")).alias("areas"))


def admin_vendors(m: Market) -> DataFrame:
    products = m.product.groupBy(F.col("vendor_id").alias("id")).agg(F.count("*").alias("products"))
    orders = m.vendor_order.groupBy(F.col("vendor_id").alias("id")).agg(F.count("*").alias("orders"))
    users = m.app_user.select(F.col("id").alias("user_id"), "phone")
    places = m.governorate.select(F.col("id").alias("governorate_id"), F.col("name_ar").alias("governorate"))
    rows = m.vendor.join(users, "user_id").join(places, "governorate_id", "left").join(products, "id", "left").join(orders, "id", "left")
    return rows.select("id", "store_name", "status", "phone", "governorate", F.coalesce("products", F.lit(0)).alias("products"), F.coalesce("orders", F.lit(0)).alias("orders"))


def admin_categories(m: Market) -> DataFrame:
    products = m.product.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("products"))
    children = m.category.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    rows = m.category.join(products, "id", "left").join(children, "id", "left")
    rows = rows.select("id", "name_ar", "parent_id", "is_active", F.coalesce("products", F.lit(0)).alias("products"), F.coalesce("children", F.lit(0)).alias("children"))
    return rows.withColumn("removable", (F.col("products") == 0) & (F.col("children") == 0)).orderBy(F.asc_nulls_last("parent_id"), "id")


def pending_products(m: Market) -> DataFrame:
    vendors = m.vendor.select(F.col("id").alias("vendor_id"), "store_name")
    names = m.category.select(F.col("id").alias("category_id"), F.col("name_ar").alias("category_name"))
    return m.product.filter("status = 'PENDING_REVIEW'").join(vendors, "vendor_id").join(names, "category_id").select("id", "title", "store_name", "category_name").orderBy("id")


def user_search(m: Market, term: str = "00012", role: str | None = "CUSTOMER", limit: int = 100) -> DataFrame:
    rows = m.app_user.filter(F.col("phone").contains(term) | F.col("name").contains(term))
    rows = rows if role is None else rows.filter(F.col("role") == role)
    return rows.orderBy(F.desc("id")).limit(limit).select("id", "phone", "name", "role")


def audit_feed(m: Market, limit: int = 50) -> DataFrame:
    users = m.app_user.select(F.col("id").alias("actor_id"), "name", "phone")
    rows = m.audit_log.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).join(users, "actor_id", "left")
    return rows.select("id", "action", stamp("created_at"), F.coalesce("name", "phone", F.lit("النظام")).alias("actor"))


def settings(m: Market, rows: list[tuple[str, str]]) -> DataFrame:
    """The two settings of rows (key, value) as numbers; a value of another JSON type gives the default."""
    return typed(m.spark.createDataFrame(rows, "key string, value string"))


def favorites(m: Market) -> DataFrame:
    """What each user holds after all toggles: an odd number of them."""
    return m.favorite_toggle.groupBy("user_id", "product_id").agg(F.count("*").alias("toggles")).filter("toggles % 2 = 1").select("user_id", "product_id")


def favorites_list(m: Market) -> DataFrame:
    products = m.product.filter("status = 'ACTIVE'").select(F.col("id").alias("product_id"), "title", F.col("base_price").cast("double").alias("base_price"))
    return favorites(m).join(products, "product_id").select("user_id", "product_id", "title", "base_price")


def product_reviews(m: Market) -> DataFrame:
    users = m.app_user.select(F.col("id").alias("user_id"), "name")
    rows = m.review.filter("status = 'PUBLISHED'").join(users, "user_id", "left")
    return rows.select("id", "product_id", "rating", F.coalesce("name", F.lit("مستخدم")).alias("reviewer"), stamp("created_at"))


def review_eligibility(m: Market) -> DataFrame:
    """Reviews with whether their writer has a realised order of the product; the newest of a user and product counts."""
    bought = m.order_item.join(m.checkout.filter(F.col("status").isin(*rules.REALISED)).select("checkout_id", "customer_id"), "checkout_id").select(F.col("customer_id").alias("user_id"), "product_id").distinct().withColumn("eligible", F.lit(True))
    newest = m.review.groupBy("user_id", "product_id").agg(F.max(F.struct("created_at", "id", "rating")).alias("r"))
    return newest.join(bought, ["user_id", "product_id"], "left").select("user_id", "product_id", F.col("r.id").alias("id"), F.col("r.rating").alias("rating"), F.coalesce("eligible", F.lit(False)).alias("eligible"))


def notif_feed(m: Market, limit: int = 30) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = m.notification.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    return rows.select("user_id", "place", "id", "type", F.col("read_at").isNotNull().alias("is_read"), stamp("created_at"))


def notif_unread(m: Market) -> DataFrame:
    return m.notification.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"), F.count("*").alias("total"))


def addresses(m: Market) -> DataFrame:
    """Two made-up addresses for each customer; the first is the default unless the customer's key divides by three."""
    rows = m.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return rows.select((F.col("user_id") * 2 + F.col("k")).alias("id"), "user_id", ((F.col("n") + F.col("k")) % 25).alias("area_id"), ((F.col("k") == 0) == (F.col("user_id") % 3 != 0)).alias("is_default"))


def address_list(m: Market) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("is_default"), F.desc("id"))
    areas = m.area.select(F.col("id").alias("area_id"), F.col("name_ar").alias("area"), "governorate_id").join(m.governorate.select(F.col("id").alias("governorate_id"), F.col("name_ar").alias("governorate")), "governorate_id")
    return addresses(m).withColumn("place", F.row_number().over(order)).join(areas, "area_id").select("user_id", "place", "id", "area", "governorate", "is_default")


def default_address(m: Market) -> DataFrame:
    """The default, else the first of a user's addresses."""
    return addresses(m).groupBy("user_id").agg(F.max_by("id", F.struct("is_default", -F.col("id"))).alias("address_id"))


def sent_within(codes: DataFrame, windows: dict[str, str], hot_rows: int = 1_000_000) -> DataFrame:
    """codes (id, phone_key, created_at, ...) with how many were sent to the same phone from each interval before on, both bounds and codes
    of the same moment included, the code itself too.

    A window is the difference of two running counts: up to the moment, and up to just before the window opens. Moments are
    counted once and the sums are taken in order, so neither a crowded window nor a phone with very many codes costs more."""
    moments = codes.groupBy("phone_key", "created_at").agg(F.count("*").alias("n"))
    marks = [(F.expr(f"created_at - interval {span}"), F.lit(0).cast("long")) for span in windows.values()] + [(F.col("created_at"), F.col("n"))]
    # A window's opening comes before the codes of its moment, which belong to it.
    marks = F.array(*[F.struct(at.alias("at"), F.lit(k).alias("turn"), n.alias("n")) for k, (at, n) in enumerate(marks)])
    rows = store(moments.select("phone_key", "created_at", F.explode(marks).alias("m")).select("phone_key", "created_at", "m.*"), "moments")
    sums = running_sums(rows, "phone_key", ["at", "turn"], {"so_far": F.col("n")}, hot_rows)
    up_to = lambda turn: F.max(F.when(F.col("turn") == turn, F.col("so_far")))
    counts = sums.groupBy(F.col("phone_key").alias("phone"), F.col("created_at").alias("moment")).agg(*[(up_to(len(windows)) - up_to(k)).alias(name) for k, name in enumerate(windows)])
    met = F.col("phone_key").eqNullSafe(F.col("phone")) & F.col("created_at").eqNullSafe(F.col("moment"))
    return codes.join(counts, met).drop("phone", "moment")


def otp_rate_limit(m: Market, hours: int = 24, most: int = 3) -> DataFrame:
    """Codes sent to the same phone within the hours before (itself left out), and whether the limit refuses another."""
    return sent_within(m.otp_code, {"recent": f"{hours} hours"}).select("id", "phone_key", "recent", (F.col("recent") > most).alias("refused"))


def otp_refusals(codes: DataFrame) -> DataFrame:
    """Codes (id, phone_key, created_at) by the reference's limit: another code is refused when 3 or more were sent to the phone
    in the 10 minutes before, or 8 or more in the 60 minutes before, both bounds and codes of the same moment included. The
    code itself is left out of both counts."""
    sent = sent_within(codes, {"short": "10 minutes", "long": "60 minutes"})
    rows = sent.select("id", "phone_key", (F.col("short") - 1).alias("short"), (F.col("long") - 1).alias("long"))
    return rows.withColumn("refused", (F.col("short") >= 3) | (F.col("long") >= 8))


def otp_limits(m: Market) -> DataFrame:
    """The limit over the sign-up codes, as if every fourth user shared one phone and time ran a hundred times as fast, so that
    both windows refuse some."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    fast = start + F.make_dt_interval(secs=(F.unix_seconds(F.col("created_at").cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 100)
    return otp_refusals(m.otp_code.select("id", (F.col("phone_key") % 4).alias("phone_key"), fast.alias("created_at")))


def otp_state(m: Market, as_of: str = "2024-01-15 00:00:00", seconds: int = 300) -> DataFrame:
    """Each phone's newest code and whether it is still valid; earlier ones are void."""
    newest = m.otp_code.groupBy("phone_key").agg(F.max(F.struct("created_at", "id")).alias("c"), F.count("*").alias("codes"))
    expires = F.col("c.created_at") + F.expr(f"interval {seconds} seconds")
    return newest.select("phone_key", F.col("c.id").alias("id"), "codes", (expires > F.lit(as_of).cast("timestamp_ntz")).alias("valid"))


def session_state(m: Market, as_of: str = "2024-01-15 00:00:00", days: int = 30) -> DataFrame:
    """Sign-ins as sessions: each is closed by the next of its user; the last is open until it lapses."""
    turn = Window.partitionBy("phone_key").orderBy("created_at", "id")
    rows = m.otp_code.select("id", "phone_key", "created_at", F.lead("id").over(turn).alias("rotated_to"))
    lapses = F.col("created_at") + F.expr(f"interval {days} days")
    return rows.select("id", "phone_key", F.col("rotated_to").cast("string").alias("rotated_to"), (F.col("rotated_to").isNull() & (lapses > F.lit(as_of).cast("timestamp_ntz"))).alias("open"))


def block_user(m: Market) -> DataFrame:
    """Blocked users with how many of their sessions are revoked."""
    sessions = m.otp_code.groupBy(F.col("phone_key").alias("id")).agg(F.count("*").alias("revoked"))
    return m.app_user.filter("is_blocked").join(sessions, "id", "left").select("id", "phone", F.coalesce("revoked", F.lit(0)).alias("revoked"))


def product_review_flow(m: Market) -> DataFrame:
    """Statuses after: drafts and rejected products are submitted, active ones of suspended vendors edited, others kept."""
    vendors = m.vendor.select(F.col("id").alias("vendor_id"), F.col("status").alias("vendor_status"))
    s = F.col("status")
    after = F.when(s.isin("DRAFT", "REJECTED"), "PENDING_REVIEW").when((s == "ACTIVE") & (F.col("vendor_status") == "SUSPENDED"), "PENDING_REVIEW").otherwise(s)
    return m.product.join(vendors, "vendor_id", "left").select("id", "status", after.alias("after"))


def quality_report(m: Market) -> DataFrame:
    """Rows that break each rule; a null breaks it. Each table is read once for all its rules."""
    def of(rows: DataFrame, **rules: Column) -> DataFrame:
        counts = rows.agg(F.count("*").alias("total"), *[F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in rules.items()])
        lines = F.array(*[F.struct(F.lit(name.replace("__", ".")).alias("rule_id"), F.col(name).alias("broken")) for name in rules])
        return counts.select(F.explode(lines).alias("r"), "total").select("r.rule_id", "r.broken", "total")

    price = lambda c: (F.col(c) >= 250) & (F.col(c) <= 100000000) & (F.col(c) % 1 == 0)
    parts = [
        of(m.app_user, user__phone=text.normalize_phone(F.col("phone")).isNotNull(), user__name=F.length("name").between(2, 60)),
        of(m.product, product__title=F.length("title").between(3, 120), product__price=price("base_price"), product__category=F.col("category_id").isNotNull()),
        of(m.review, review__rating=F.col("rating").between(1, 5)),
        of(m.order_item, cart__quantity=F.col("quantity").between(1, 99)),
        of(m.product_variant, variant__stock=F.col("stock").between(0, 1000000), variant__price=price("price")),
        of(m.vendor, vendor__store_name=F.length("store_name").between(2, 80), vendor__commission_rate=F.coalesce("commission_rate", F.lit(0)).between(0, 1), vendor__governorate=F.col("governorate_id").isNotNull()),
        of(m.category, category__name=F.length("name_ar").between(2, 60)),
    ]
    return reduce(DataFrame.unionByName, parts)


def image_is_valid(url: Column) -> Column:
    """An https address, a path inside the site, or the data of an image, each up to its length; null is none of them."""
    # The patterns and lengths.
    https = url.rlike(r"^https://[^\s]+$") & (F.length(url) <= 2000)
    path = url.rlike(r"^/[a-zA-Z0-9/_.-]+$") & (F.length(url) <= 300)
    data = url.rlike(r"^data:image/(jpeg|png|webp);base64,[A-Za-z0-9+/=]+$")
    return F.coalesce((F.length(url) <= 350000) & (https | path | data), F.lit(False))


def code_is_valid(code: Column) -> Column:
    return F.coalesce(F.trim(code).rlike("^[0-9]{4,8}$"), F.lit(False))


def text_normalize(m: Market) -> DataFrame:
    return m.raw("documents").select("doc_id", F.sha2(text.normalize_arabic(F.col("text")), 256).alias("sha256"))


def slugs(m: Market) -> DataFrame:
    return m.raw("documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


def token_counts(m: Market) -> DataFrame:
    return m.raw("documents").select("doc_id", F.size(text.tokenize(F.col("text"))).alias("tokens"))


def phone_normalize(m: Market) -> DataFrame:
    local = F.concat(F.lit("0"), F.substring("phone", 5, 10))
    return m.app_user.select("id", text.normalize_phone(local).alias("phone"), text.local_phone(F.col("phone")).alias("local"), text.normalize_phone(F.substring("phone", 2, 8)).alias("short"))


def iqd_format(m: Market) -> DataFrame:
    return m.product.select("id", text.format_iqd(F.col("base_price")).alias("price"))


def iqd_parse(m: Market) -> DataFrame:
    return m.product.select("id", text.parse_iqd(text.format_iqd(F.col("base_price"))).alias("amount"), text.parse_iqd(F.col("title")).alias("of_title"))
