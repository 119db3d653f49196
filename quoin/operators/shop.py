"""What shop pages and account screens show: carts, labels, fallbacks, single records, guards and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import rules, text
from quoin.operators.catalog import approved_stores, listed
from quoin.sources.market import DELIVERY_FEE, MONEY, Market


def cart_lines(adds: DataFrame, variants: DataFrame, *also: str) -> DataFrame:
    """adds (cart_id, variant_id, quantity of one or more) as lines: a line holds all that was added, at most what is available.
    ``also`` names further columns of the variants."""
    stock = variants.select(F.col("id").alias("variant_id"), "price", *also, rules.available(F.col("stock"), F.col("reserved_stock")).alias("most"))
    sums = adds.groupBy("cart_id", "variant_id").agg(F.sum("quantity").alias("asked"))
    return sums.join(stock, "variant_id").select("cart_id", "variant_id", F.least(F.col("asked"), F.col("most")).cast("int").alias("quantity"), "price", *also)


def cart_totals(m: Market) -> DataFrame:
    """Each checkout's lines as a cart: units, subtotal, and delivery for each of its distinct vendors."""
    owners = m.product.select(F.col("id").alias("product_id"), "vendor_id")
    goods = m.product_variant.join(owners, "product_id").select("id", "price", "stock", "reserved_stock", "vendor_id")
    adds = m.order_item.select(F.col("checkout_id").alias("cart_id"), "variant_id", "quantity")
    # Lines move twice: by variant, where they are summed and meet it, and by cart.
    lines = m.dealt(cart_lines(m.dealt(adds, "variant_id"), m.dealt(goods, "id"), "vendor_id"), "cart_id")
    parts = lines.groupBy("cart_id", "vendor_id").agg(F.sum("quantity").alias("units"), F.sum(F.col("price") * F.col("quantity")).alias("subtotal"))
    sums = parts.groupBy("cart_id").agg(F.sum("units").alias("units"), F.sum("subtotal").cast(MONEY).alias("subtotal"), F.count("vendor_id").alias("vendors"))
    delivery = F.col("vendors") * DELIVERY_FEE
    return sums.select("cart_id", "units", F.col("subtotal").cast("double").alias("subtotal"), delivery.cast("double").alias("delivery"), (F.col("subtotal") + delivery).cast("double").alias("total"))


def change_carts(changes: DataFrame, variants: DataFrame) -> DataFrame:
    """Lines (cart_id, variant_id, quantity, price) after changes (cart_id, variant_id, seq, op, quantity) in the order of seq, which
    differs within a line. 'add' (one or more) puts units on a line or makes it, up to what is available; 'set' changes a
    line that is there, to nothing at zero or less; 'remove' takes it away. Lines without units aren't kept; unknown
    variants and null keys have none.

    Nothing is folded row by row: what counts are the adds behind a line's last removal, from the last 'set' on that finds it.
    These moments are aggregates, combined before each shuffle, so a line with very many changes is no task of its own."""
    line = ["cart_id", "variant_id"]
    gone = (F.col("op") == "remove") | ((F.col("op") == "set") & (F.col("quantity") <= 0))
    add, put = F.col("op") == "add", F.col("op") == "set"
    cleared = changes.filter(gone).groupBy(*line).agg(F.max("seq").alias("cleared"))
    alive = changes.filter(~gone).join(cleared, line, "left").filter(F.col("cleared").isNull() | (F.col("seq") > F.col("cleared"))).drop("cleared")
    made = alive.filter(add).groupBy(*line).agg(F.min("seq").alias("made"))
    there = alive.join(made, line).filter(F.col("seq") >= F.col("made"))
    last = there.filter(put).groupBy(*line).agg(F.max("seq").alias("last"))
    counted = there.join(last, line, "left").filter(F.col("last").isNull() | (F.col("seq") >= F.col("last")))
    stock = variants.select(F.col("id").alias("variant_id"), "price", rules.available(F.col("stock"), F.col("reserved_stock")).alias("most"))
    units = counted.groupBy(*line).agg(F.sum("quantity").alias("asked"))
    return units.join(stock, "variant_id").select(*line, F.least(F.col("asked"), F.col("most")).cast("int").alias("quantity"), "price").filter("quantity > 0")


def cart_changes(m: Market) -> DataFrame:
    """Every event as a change of its user's cart; what it does and to which variant depends on its key."""
    key = F.col("event_id")
    op = F.when(key % 11 == 3, "remove").when(key % 3 == 1, "set").otherwise("add")
    quantity = F.when(op == "set", key % 6 - 1).otherwise(key % 4 + 1)
    made = m.raw("events").select(F.col("user_id").alias("cart_id"), ((key % 7 + 1) * 10).alias("variant_id"), key.alias("seq"), op.alias("op"), quantity.alias("quantity"))
    return change_carts(made, m.product_variant).withColumn("price", F.col("price").cast("double"))


def review_mine(m: Market) -> DataFrame:
    """Each user's own review of each product, the newest if there are several, whatever its status."""
    newest = m.review.groupBy("user_id", "product_id").agg(F.max(F.struct("created_at", "id", "rating", "status")).alias("r"))
    return newest.select("user_id", "product_id", "r.id", "r.rating", "r.status")


def auth_me(m: Market, user_id: int | None = None) -> DataFrame:
    """What a user who isn't blocked sees of itself; all such users if none is named."""
    rows = m.app_user if user_id is None else m.app_user.filter(F.col("id") == user_id)
    return rows.filter("not is_blocked").select("id", "phone", "name", "role")


def vendor_product_detail(m: Market) -> DataFrame:
    """Every product as its vendor sees it, with all variants by id, inactive ones included, as id:price:stock:active."""
    line = F.concat_ws(":", F.col("id").cast("string"), F.col("price").cast("string"), F.col("stock").cast("string"), F.col("is_active").cast("string"))
    lists = m.product_variant.select(F.col("product_id").alias("id"), F.struct("id", line.alias("line")).alias("v")).groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return m.product.join(lists, "id", "left").select("id", "vendor_id", "title", "category_id", F.col("base_price").cast("double").alias("base_price"), "status", F.array_join(F.transform(F.coalesce("v", F.array()), lambda v: v["line"]), ",").alias("variants"))


def local_products(m: Market, limit: int = 10) -> DataFrame:
    """For each governorate the newest listed products of its vendors; where there are none, those of the whole country."""
    newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("id")))
    local = listed(m).filter("governorate_id is not null").select("governorate_id", "id", newest("governorate_id").alias("place")).filter(F.col("place") <= limit)
    everywhere = listed(m).orderBy(F.desc("id")).limit(limit).select("id", newest(F.lit(1)).alias("place"))  # ``limit`` rows
    empty = m.governorate.select(F.col("id").alias("governorate_id")).join(local.select("governorate_id").distinct(), "governorate_id", "left_anti")
    places = empty.select("governorate_id", F.explode(F.sequence(F.lit(1), F.lit(limit))).alias("place"))
    return local.withColumn("is_local", F.lit(True)).unionByName(places.join(everywhere, "place").select("governorate_id", "id", "place", F.lit(False).alias("is_local")))


def local_stores(m: Market, limit: int = 60) -> DataFrame:
    """For each governorate its approved stores by rating; where there are none, those of the whole country."""
    stores = approved_stores(m).select("governorate_id", "id", "rating_avg")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rating_avg"), "id"))
    local = stores.filter("governorate_id is not null").withColumn("place", best("governorate_id")).filter(F.col("place") <= limit)
    everywhere = stores.orderBy(F.desc("rating_avg"), "id").limit(limit).select("id", "rating_avg", best(F.lit(1)).alias("place"))  # ``limit`` rows
    empty = m.governorate.select(F.col("id").alias("governorate_id")).join(local.select("governorate_id").distinct(), "governorate_id", "left_anti")
    places = empty.select("governorate_id", F.explode(F.sequence(F.lit(1), F.lit(limit))).alias("place")).join(everywhere, "place")
    columns = ("governorate_id", "id", "place", "rating_avg")
    return local.select(*columns, F.lit(True).alias("is_local")).unionByName(places.select(*columns, F.lit(False).alias("is_local")))


def variant_label(attributes: Column) -> Column:
    """Attributes as 'key: value' in the order of the map. The separator and the label without attributes."""
    parts = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(F.size(F.coalesce(attributes, F.create_map().cast("map<string,string>"))) > 0, F.array_join(parts, "، ")).otherwise("افتراضي")


def variant_labels(m: Market) -> DataFrame:
    """Labels of variants whose made-up attributes are size and brand; a product's first variant has none."""
    rows = m.product_variant.join(m.raw("part").select(F.col("p_partkey").alias("product_id"), "p_size", "p_brand"), "product_id")
    attributes = F.when(F.col("id") % 10 != 0, F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")))
    return rows.select("id", variant_label(attributes).alias("label"))


def rate_percent(m: Market) -> DataFrame:
    """Commission rates as whole percents are shown, and as percents that lose nothing."""
    return m.vendor.filter("commission_rate is not null").select("id", F.floor(F.col("commission_rate") * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("long").alias("shown"), (F.col("commission_rate") * 100).cast("double").alias("percent"))


def slug_decode(slug: Column) -> Column:
    """Percent escapes decoded, '+' left as it is; a slug that can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(slug, r"\+", "%2B")), slug)


def slug_round_trip(m: Market) -> DataFrame:
    """Titles as slugs in addresses, and decoded again."""
    encoded = F.url_encode(text.slugify(F.concat(F.lit("متجر + "), F.col("title"))))
    return m.product.select("id", encoded.alias("encoded"), slug_decode(encoded).alias("slug"), slug_decode(F.lit("a+b%zz")).alias("broken"))


def session_tokens(m: Market) -> DataFrame:
    """What is kept of a session's token: its sha256."""
    return m.otp_code.select("id", F.sha2(F.concat(F.lit("token-"), F.col("id").cast("string")), 256).alias("token_hash"))


def ship_to(m: Market) -> DataFrame:
    """The address as it is kept with an order, as JSON."""
    areas = m.area.join(m.governorate.select(F.col("id").alias("governorate_id"), F.col("name_ar").alias("governorate")), "governorate_id").select(F.col("id").alias("area_id"), "governorate", F.col("name_ar").alias("area"))
    rows = m.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("fullName"), F.col("c_nationkey").alias("area_id")).join(areas, "area_id")
    return rows.select("id", F.to_json(F.struct("fullName", "governorate", "area")).alias("ship_to"))


def next_statuses(m: Market) -> DataFrame:
    """For each status in use and each actor the statuses that the actor may set, in the order of their names."""
    edges = rules.allowed_targets(m.spark)
    actors = F.explode(F.array_union("actors", F.array(F.lit("ADMIN")))).alias("actor")
    targets = edges.select(F.col("old").alias("status"), "new", actors).groupBy("status", "actor").agg(F.array_join(F.sort_array(F.collect_list("new")), ",").alias("targets"))
    return m.checkout.groupBy("status").agg(F.count("*").alias("checkouts")).join(targets, "status")


def role_guard(m: Market) -> DataFrame:
    """How many users each role of a procedure lets in; administrators pass everywhere."""
    wanted = F.explode(F.array(*map(F.lit, ("CUSTOMER", "VENDOR", "ADMIN")))).alias("wanted")
    users = m.app_user.select(F.when(F.col("id") % 97 == 5, "ADMIN").otherwise(F.col("role")).alias("role"), wanted)
    return users.groupBy("wanted").agg(F.count_if(rules.has_role(F.col("role"), F.col("wanted"))).alias("allowed"), F.count("*").alias("users"))


def verify_codes(tries: DataFrame, seconds: int = 300, most: int = 5) -> DataFrame:
    """tries (code_id, sent_at, at, seq, matches) of codes, in the order of (at, seq): 'ok' for the first match, 'wrong' for another
    code, 'expired' from the code's expiry on, 'too_many' for the try after ``most`` wrong ones, and 'none' once the code
    is consumed by a match or by too many tries. Expired tries count neither as wrong ones nor as matches."""
    before = Window.partitionBy("code_id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("at") >= F.col("sent_at") + F.make_dt_interval(secs=F.lit(seconds))
    none = F.lit(0)
    rows = tries.withColumn("late", late).withColumn("wrong", F.coalesce(F.count_if(~F.col("late") & ~F.col("matches")).over(before), none))
    rows = rows.withColumn("hit", ~F.col("late") & F.col("matches") & (F.col("wrong") < most)).withColumn("full", ~F.col("late") & (F.col("wrong") >= most))
    done = F.coalesce(F.max(F.col("hit") | F.col("full")).over(before), F.lit(False))
    verdict = F.when(done, "none").when(F.col("late"), "expired").when(F.col("full"), "too_many").when(F.col("matches"), "ok").otherwise("wrong")
    return rows.withColumn("verdict", verdict).drop("late", "wrong", "hit", "full")


def otp_verify(m: Market) -> DataFrame:
    """Every sign-up code with up to eight made-up tries; which of them match and when depends on the code's key."""
    key = F.col("id")
    tries = m.otp_code.select(F.col("id").alias("code_id"), F.col("created_at").alias("sent_at"), F.explode(F.sequence(F.lit(1), (key % 8 + 1).cast("int"))).alias("seq"))
    at = F.col("sent_at") + F.make_dt_interval(secs=F.col("seq") * (F.col("code_id") % 9 * 10 + 5))
    tries = tries.withColumn("at", at).withColumn("matches", F.col("seq") == F.col("code_id") % 7 + 1)
    return verify_codes(tries).select("code_id", "seq", "matches", "verdict")


def change_categories(categories: DataFrame, products: DataFrame, changes: DataFrame) -> DataFrame:
    """categories (id, name_ar, parent_id, is_active) after changes (kind, id, name_ar, parent_id, is_active; one for each id): create
    adds a row, update takes the fields that aren't null, remove deletes a category without products and children. Each
    row says which change it took ('kept' for none); refused and removed ones are in the rows too."""
    used = products.select(F.col("category_id").alias("id")).unionByName(categories.filter("parent_id is not null").select(F.col("parent_id").alias("id"))).distinct().withColumn("used", F.lit(True))
    new = changes.filter("kind = 'create'").select("id", "name_ar", "parent_id", F.coalesce("is_active", F.lit(True)).alias("is_active"), F.lit("category.create").alias("action"))
    own = changes.filter("kind <> 'create'").select("id", "kind", F.col("name_ar").alias("to_name"), F.col("is_active").alias("to_active"))
    rows = categories.join(own, "id", "left").join(used, "id", "left")
    action = F.when(F.col("kind") == "update", "category.update").when(F.col("kind") == "remove", F.when(F.col("used"), "refused").otherwise("category.delete")).otherwise("kept")
    is_update = F.coalesce(F.col("kind") == "update", F.lit(False))
    field = lambda new, old: F.coalesce(F.when(is_update, F.col(new)), F.col(old)).alias(old)
    return rows.select("id", field("to_name", "name_ar"), "parent_id", field("to_active", "is_active"), action.alias("action")).unionByName(new)


def category_changes(m: Market) -> DataFrame:
    """Leaves of some brands are renamed, hidden or asked to go; each root has an empty child that is asked to go, and
    gets a new one."""
    leaf, root = m.category.filter("parent_id is not null"), m.category.filter("parent_id is null")
    brand = F.col("name_ar")
    null = lambda t: F.lit(None).cast(t)
    own = leaf.filter(brand.isin("Brand#11", "Brand#12", "Brand#14")).select(F.when(brand == "Brand#14", "remove").otherwise("update").alias("kind"), "id", F.when(brand == "Brand#11", F.concat(brand, F.lit(" new"))).alias("name_ar"), null("string").alias("parent_id"), F.when(brand == "Brand#12", F.lit(False)).alias("is_active"))
    born = root.select(F.lit("create").alias("kind"), F.concat("id", F.lit("/new")).alias("id"), F.lit("New").alias("name_ar"), F.col("id").alias("parent_id"), null("boolean").alias("is_active"))
    empty = m.category.unionByName(root.select(F.concat("id", F.lit("/empty")).alias("id"), F.lit("Empty").alias("name_ar"), F.col("id").alias("parent_id"), F.lit(True).alias("is_active")))
    gone = root.select(F.lit("remove").alias("kind"), F.concat("id", F.lit("/empty")).alias("id"), null("string").alias("name_ar"), null("string").alias("parent_id"), null("boolean").alias("is_active"))
    return change_categories(empty, m.product, own.unionByName(born).unionByName(gone))
