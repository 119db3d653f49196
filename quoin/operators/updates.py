"""Updates as set-based transforms: a table and a batch of changes give the table afterwards.

Changes carry the user or vendor that asks for them; those on rows of others change nothing. Where the order of changes
matters they carry ``seq``. The batches of the registered queries are functions of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import text
from quoin.operators.accounts import addresses
from quoin.operators.orders import stamp
from quoin.sources.market import Market

CHANGED_AT = "2024-02-01 00:00:00"


def set_fields(rows: DataFrame, changes: DataFrame, key: str, owner: str, fields: tuple[str, ...]) -> DataFrame:
    """rows with the fields that changes name; a null leaves the old value. changes: key, owner, fields, at most one row for
    each key and owner."""
    new = changes.select(key, owner, *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = rows.join(new, [key, owner], "left")
    return joined.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def change_addresses(rows: DataFrame, changes: DataFrame, areas: DataFrame) -> DataFrame:
    """Addresses (id, user_id, area_id, is_default) after changes (user_id, seq, kind, id, area_id, governorate_id, is_default).

    create needs an area of the governorate given, and is the default if asked or if it is the user's only address;
    update takes area_id (unchecked) and is_default where not null; default makes an address the only default; remove
    deletes it and picks no new default. Changes to addresses that aren't there or are another user's have no effect.
    """
    places = areas.select(F.col("id").alias("area_id"), "governorate_id")
    born = changes.filter("kind = 'create'").join(places, ["area_id", "governorate_id"], "left_semi")
    known = rows.select("id", "user_id", "area_id", F.coalesce("is_default", F.lit(False)).alias("is_default"), F.lit(-1).cast("long").alias("born"))
    known = known.unionByName(born.select("id", "user_id", "area_id", F.coalesce("is_default", F.lit(False)).alias("is_default"), F.col("seq").cast("long").alias("born")))
    own = changes.filter("kind <> 'create'").select("id", "user_id", "seq", "kind", F.col("area_id").alias("to_area"), F.col("is_default").alias("to_default"))
    later = known.select("id", "user_id", "born").join(own, ["id", "user_id"]).filter("seq > born")
    removed = Window.partitionBy("id")
    later = later.withColumn("gone", F.min(F.when(F.col("kind") == "remove", F.col("seq"))).over(removed)).filter("gone is null or seq <= gone")
    by_id = later.groupBy("id").agg(
        F.max("gone").alias("gone"),
        F.max_by("to_area", F.when((F.col("kind") == "update") & F.col("to_area").isNotNull(), F.col("seq"))).alias("to_area"),
        F.max(F.when((F.col("kind") == "default") | ((F.col("kind") == "update") & F.col("to_default")), F.col("seq"))).alias("claimed"),
        F.max(F.when((F.col("kind") == "update") & ~F.col("to_default"), F.col("seq"))).alias("unset"),
    )
    all_rows = known.join(by_id, "id", "left")
    # How many addresses the user had before each creation.
    steps = all_rows.select("id", "user_id", F.explode(F.array(F.struct(F.col("born").alias("at"), F.lit(1).alias("by")), F.struct(F.col("gone").cast("long").alias("at"), F.lit(-1).alias("by")))).alias("s")).select("id", "user_id", "s.*").filter("at is not null")
    before = Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    first = steps.withColumn("had", F.coalesce(F.sum("by").over(before), F.lit(0))).filter("by = 1 and at >= 0 and had = 0").select("id", F.lit(True).alias("only"))
    all_rows = all_rows.join(first, "id", "left").withColumn("claim", F.greatest("claimed", F.when((F.col("born") >= 0) & (F.col("is_default") | F.coalesce("only", F.lit(False))), F.col("born"))))
    last = all_rows.groupBy("user_id").agg(F.max(F.when(F.col("claim").isNotNull(), F.struct("claim", "id"))).alias("last"))
    flag = F.when(F.col("last").isNull(), F.col("is_default")).otherwise(F.col("id") == F.col("last.id")) & (F.coalesce("unset", F.lit(-2)) <= F.coalesce("last.claim", F.lit(-2)))
    return all_rows.join(last, "user_id").filter("gone is null").select("id", "user_id", F.coalesce("to_area", "area_id").alias("area_id"), flag.alias("is_default"))


def address_changes(m: Market) -> DataFrame:
    """Each customer creates an address (its governorate is wrong for every fifth); some set a default, move or remove one."""
    key = F.col("c_custkey")
    base = m.raw("customer").select(key.alias("user_id"), F.col("c_nationkey").alias("area_id")).join(m.area.select(F.col("id").alias("area_id"), "governorate_id"), "area_id")
    u, no = F.col("user_id"), F.lit(None)
    change = lambda when, seq, kind, at, area, governorate, default: F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), at.cast("long").alias("id"), area.cast("int").alias("area_id"), governorate.cast("int").alias("governorate_id"), default.cast("boolean").alias("is_default")))
    every = F.array(
        change(F.lit(True), 1, "create", u * 2 + 10_000_000, F.col("area_id"), F.col("governorate_id") + F.when(u % 5 == 0, 1).otherwise(0), u % 4 == 0),
        change(u % 7 == 1, 2, "default", u * 2 + 1, no, no, no),
        change(u % 3 == 2, 3, "update", u * 2, (F.col("area_id") + 3) % 25, no, F.when(u % 6 == 5, F.lit(False))),
        change(u % 11 == 4, 4, "remove", u * 2, no, no, no),
        change(u % 13 == 6, 5, "remove", u * 2 + 2, no, no, no),
    )
    batch = base.select("user_id", F.explode(F.filter(every, lambda c: c.isNotNull())).alias("c")).select("user_id", "c.*")
    return change_addresses(addresses(m), batch, m.area)


def mark_read(rows: DataFrame, single: DataFrame, every: DataFrame) -> DataFrame:
    """Notifications after marks on single ones (id, user_id, at), which replace an earlier read_at, and marks on all of a
    user's (user_id, at), which touch unread ones only."""
    one = single.groupBy("id", "user_id").agg(F.max("at").alias("one_at"))
    whole = every.groupBy("user_id").agg(F.min("at").alias("all_at"))
    joined = rows.join(one, ["id", "user_id"], "left").join(whole, "user_id", "left")
    return joined.select(*[F.coalesce("one_at", "read_at", "all_at").alias(c) if c == "read_at" else F.col(c) for c in rows.columns])


def notif_mark_read(m: Market) -> DataFrame:
    at = F.lit(CHANGED_AT).cast("timestamp_ntz").alias("at")
    single = m.notification.filter("id % 11 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"), at)
    rows = mark_read(m.notification, single, m.app_user.filter("id % 10 = 3").select(F.col("id").alias("user_id"), at))
    return rows.select("id", "user_id", stamp("read_at"))


def push_subscriptions(m: Market) -> DataFrame:
    """Each endpoint belongs to the user who subscribed it last, unless that user unsubscribed it afterwards."""
    log = m.raw("events").filter(F.col("event_type").isin("click", "error")).select(F.concat(F.lit("https://push.example/"), F.col("user_id") % 40).alias("endpoint"), "user_id", F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("joins"))
    last = log.filter("joins").groupBy("endpoint").agg(F.max(F.struct("seq", "user_id")).alias("l")).select("endpoint", "l.*")
    left = log.filter("not joins").groupBy("endpoint", "user_id").agg(F.max("seq").alias("left_at"))
    return last.join(left, ["endpoint", "user_id"], "left").filter("left_at is null or left_at < seq").select("endpoint", "user_id")


def vendor_register(m: Market) -> DataFrame:
    """Profiles of users who apply; one who has a profile is refused. The slug ends in the last five signs of the user's id."""
    asks = m.app_user.filter("name is not null and id % 7 = 3").select(F.col("id").alias("user_id"), "name")
    new = asks.join(m.vendor.select("user_id"), "user_id", "left_anti")
    slug = F.concat(text.slugify(F.col("name")), F.lit("-"), F.expr("right(cast(user_id as string), 5)"))
    return new.select("user_id", F.col("name").alias("store_name"), slug.alias("slug"), text.normalize_arabic(F.col("name")).alias("slug_norm"), F.lit("PENDING").alias("status"), F.lit("VENDOR").alias("role"))


def vendor_settings(m: Market) -> DataFrame:
    """Every third vendor renames its store and every fourth moves; the search form of the name follows, the slug does not."""
    changes = m.vendor.filter("id % 3 = 0 or id % 4 = 0").select("id", "user_id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("متجر "), F.col("id"))).alias("store_name"), F.when(F.col("id") % 4 == 0, (F.col("id") % 5).cast("int")).alias("governorate_id"))
    rows = m.vendor.select("id", "user_id", "store_name", "governorate_id", text.slugify(F.col("store_name")).alias("slug"))
    after = set_fields(rows, changes, "id", "user_id", ("store_name", "governorate_id"))
    return after.withColumn("slug_norm", text.normalize_arabic(F.col("store_name"))).drop("user_id")


def variant_update(m: Market) -> DataFrame:
    """Vendors set price, stock and activity of their variants; stock may fall below what is reserved."""
    owners = m.product.select(F.col("id").alias("product_id"), "vendor_id")
    rows = m.product_variant.join(owners, "product_id")
    key = F.col("id")
    changes = rows.filter("id % 6 = 0").select("id", F.when(key % 4 == 0, F.col("vendor_id")).otherwise(F.col("vendor_id") + 1).alias("vendor_id"), F.when(key % 3 == 0, F.lit(2500)).cast("decimal(13,2)").alias("price"), (key % 20).cast("int").alias("stock"), F.when(key % 8 == 0, F.lit(False)).alias("is_active"))
    after = set_fields(rows, changes, "id", "vendor_id", ("price", "stock", "is_active"))
    return after.select("id", F.col("price").cast("double").alias("price"), "stock", "is_active", (F.col("stock") < F.col("reserved_stock")).alias("oversold"))


def product_archive(m: Market) -> DataFrame:
    """Whatever its status, a product is archived if its own vendor asks."""
    asks = m.product.filter("id % 9 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("vendor_id")).otherwise(F.col("vendor_id") + 1).alias("vendor_id"), F.lit("ARCHIVED").alias("status"))
    return set_fields(m.product.select("id", "vendor_id", "status"), asks, "id", "vendor_id", ("status",)).select("id", "status")


def complete_profile(m: Market) -> DataFrame:
    """Users after giving name and address; an empty address is stored as null."""
    key = F.col("id")
    given = m.app_user.filter("role = 'CUSTOMER' and id % 10 = 0").select("id", F.concat(F.lit("User "), key).alias("new_name"), F.nullif(F.when(key % 20 == 0, "").otherwise(F.concat(F.lit("u"), key, F.lit("@example.com"))), F.lit("")).alias("email"))
    return m.app_user.join(given, "id", "left").select("id", F.coalesce("new_name", "name").alias("name"), "email")
