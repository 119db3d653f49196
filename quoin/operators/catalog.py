"""Catalogue queries: search, suggestions, detail pages, stores and the category tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import rules
from quoin.sources.market import Market

SORTS = {
    "newest": [F.desc, "id"], "price_asc": [F.asc, "base_price"], "price_desc": [F.desc, "base_price"], "rating": [F.desc, "rating_avg"],
}


def sold_counts(m: Market) -> DataFrame:
    """Units sold by product, from realised orders."""
    done = m.checkout.filter(F.col("status").isin(*rules.REALISED)).select("checkout_id")
    return m.order_item.select("checkout_id", "product_id", "quantity").join(done, "checkout_id").groupBy("product_id").agg(F.sum("quantity").alias("sold_count"))


def listed(m: Market) -> DataFrame:
    """Active products of approved vendors."""
    vendors = m.vendor.filter("status = 'APPROVED'").select(F.col("id").alias("vendor_id"), "store_name", "governorate_id")
    return m.product.filter("status = 'ACTIVE'").join(vendors, "vendor_id")


def category_tree(m: Market) -> DataFrame:
    """Active roots with their active children by id, joined into one string."""
    active = m.category.filter("is_active")
    children = active.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("children"), F.count("*").alias("n_children"))
    return active.filter("parent_id is null").join(children, "id", "left").select("id", "name_ar", F.coalesce("children", F.lit("")).alias("children"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def category_ids(m: Market) -> DataFrame:
    """Each category with itself and all its direct children, active or not."""
    c = m.category
    return c.select("id", F.col("id").alias("member")).unionByName(c.filter("parent_id is not null").select(F.col("parent_id").alias("id"), F.col("id").alias("member")))


def search(m: Market, words: list[str] = (), category: str | None = None, vendor: int | None = None, governorate: int | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """All listed products that hold every word and meet the other conditions; those not given hold for all."""
    found: list[Column] = [F.col("title_norm").contains(w) for w in words]
    if vendor is not None:
        found.append(F.col("vendor_id") == vendor)
    if governorate is not None:
        found.append(F.col("governorate_id") == governorate)
    if low is not None:
        found.append(F.col("base_price") >= F.lit(low).cast("decimal(12,2)"))
    if high is not None:
        found.append(F.col("base_price") <= F.lit(high).cast("decimal(12,2)"))
    rows = listed(m)
    for condition in found:
        rows = rows.filter(condition)
    if category is not None:
        rows = rows.join(category_ids(m).filter(F.col("id") == category).select(F.col("member").alias("category_id")), "category_id", "left_semi")
    return rows.select("id", "title", "vendor_id", "store_name", "category_id", F.col("base_price").cast("double").alias("base_price"))


def page(rows: DataFrame, sort: str = "newest", limit: int = 20, after: tuple | None = None) -> DataFrame:
    """The next ``limit`` rows in the order of ``sort``, ties by id; ``after`` is the (sort key, id) of the last row seen."""
    way, key = SORTS.get(sort, SORTS["newest"])
    if after is not None:
        beyond = F.col(key) > after[0] if way is F.asc else F.col(key) < after[0]
        rows = rows.filter(beyond | ((F.col(key) == after[0]) & (F.col("id") > after[1])))
    return rows.orderBy(way(key), F.asc("id")).limit(limit)


def rated(m: Market, rows: DataFrame) -> DataFrame:
    """Product rows with rating_avg and rating_count, zero where no review is published."""
    found = product_ratings(m).select(F.col("product_id").alias("id"), "rating_avg", "rating_count")
    return rows.join(found, "id", "left").withColumns({"rating_avg": F.coalesce(F.col("rating_avg").cast("double"), F.lit(0.0)), "rating_count": F.coalesce("rating_count", F.lit(0))})


def page_ahead(rows: DataFrame, sort: str = "newest", limit: int = 20, after: tuple | None = None) -> DataFrame:
    """A page with has_next: one row more is looked for, and not returned."""
    way, key = SORTS.get(sort, SORTS["newest"])
    place = Window.orderBy(way(key), F.asc("id"))  # over one row more than a page
    seen = page(rows, sort, limit + 1, after).withColumn("place", F.row_number().over(place)).withColumn("has_next", F.max("place").over(Window.partitionBy(F.lit(1))) > limit)
    return seen.filter(F.col("place") <= limit)


def suggest(m: Market, phrase: str = "al", limit: int = 6) -> DataFrame:
    """The best sold listed products whose normalised title holds the phrase."""
    sold = F.coalesce("sold_count", F.lit(0)).alias("sold_count")
    rows = listed(m).filter(F.col("title_norm").contains(phrase)).select("id", "title").join(sold_counts(m).withColumnRenamed("product_id", "id"), "id", "left")
    return rows.select("id", "title", sold).orderBy(F.desc("sold_count"), "id").limit(limit)


def suggest_categories(m: Market, phrase: str = "brand#1", first: int = 20, limit: int = 4) -> DataFrame:
    """Of the first active categories by id those whose normalised name holds the phrase."""
    taken = m.category.filter("is_active").orderBy("id").limit(first)
    return taken.filter(F.lower("name_ar").contains(phrase)).orderBy("id").limit(limit).select("id", "name_ar")


def product_detail(m: Market) -> DataFrame:
    """Active products with vendor, category and their active variants; the vendor's status isn't asked."""
    variants = m.product_variant.filter("is_active").select("product_id", F.struct("id", F.concat_ws(":", F.col("id").cast("string"), rules.available(F.col("stock"), F.col("reserved_stock")).cast("string")).alias("line")).alias("v"))
    lists = variants.groupBy(F.col("product_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("v")), lambda v: v["line"]), ",").alias("variants"))
    vendors = m.vendor.select(F.col("id").alias("vendor_id"), "store_name")
    names = m.category.select(F.col("id").alias("category_id"), F.col("name_ar").alias("category_name"))
    rows = m.product.filter("status = 'ACTIVE'").join(vendors, "vendor_id").join(names, "category_id").join(lists, "id", "left")
    return rows.select("id", "title", "store_name", "category_name", F.col("base_price").cast("double").alias("base_price"), F.coalesce("variants", F.lit("")).alias("variants"))


def approved_stores(m: Market) -> DataFrame:
    """Approved stores with their rating, their count of active products and their governorate."""
    ratings = vendor_ratings(m)
    counts = m.product.filter("status = 'ACTIVE'").groupBy(F.col("vendor_id").alias("id")).agg(F.count("*").alias("product_count"))
    places = m.governorate.select(F.col("id").alias("governorate_id"), F.col("name_ar").alias("governorate"))
    rows = m.vendor.filter("status = 'APPROVED'").join(ratings.withColumnRenamed("vendor_id", "id"), "id", "left").join(counts, "id", "left").join(places, "governorate_id", "left")
    return rows.select("id", "store_name", "governorate_id", "governorate", F.coalesce(F.col("rating_avg").cast("double"), F.lit(0.0)).alias("rating_avg"), F.coalesce("rating_count", F.lit(0)).alias("rating_count"), F.coalesce("product_count", F.lit(0)).alias("product_count"))


def store_directory(m: Market, limit: int = 60) -> DataFrame:
    """Approved stores by rating (unrated last)."""
    return approved_stores(m).drop("governorate_id").orderBy(F.desc("rating_avg"), "id").limit(limit)


def store_page(m: Market, limit: int = 24) -> DataFrame:
    """The newest active products of each approved store."""
    newest = Window.partitionBy("vendor_id").orderBy(F.desc("id"))
    rows = listed(m).withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    return rows.select("vendor_id", "store_name", "place", "id", "title")


def product_ratings(m: Market) -> DataFrame:
    """Mean of published reviews to two places, and their number."""
    sums = m.review.filter("status = 'PUBLISHED'").groupBy("product_id").agg(F.sum("rating").alias("total"), F.count("*").alias("rating_count"))
    return sums.select("product_id", rules.mean_rating(F.col("total"), F.col("rating_count")).alias("rating_avg"), "rating_count")


def vendor_ratings(m: Market) -> DataFrame:
    """Unweighted mean over a vendor's rated products, and the sum of their counts."""
    rated = product_ratings(m).join(m.product.select(F.col("id").alias("product_id"), "vendor_id"), "product_id")
    sums = rated.groupBy("vendor_id").agg(F.sum(F.col("rating_avg") * 100).cast("long").alias("total"), F.count("*").alias("n"), F.sum("rating_count").alias("rating_count"))
    return sums.select("vendor_id", (F.floor((F.col("total") * 2 + F.col("n")) / (F.col("n") * 2)) / 100).cast("decimal(3,2)").alias("rating_avg"), "rating_count")
