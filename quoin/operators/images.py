"""Ordered lists of images as a child table: created, replaced as a whole, and the first of each product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.operators.accounts import image_is_valid
from quoin.operators.catalog import listed
from quoin.sources.market import Market

#: The most images that a product may have (fixed value).
MOST = 8


def image_rows(lists: DataFrame) -> DataFrame:
    """lists (product_id, images) as rows (product_id, sort_order, url) in the order of each list; null and empty lists have none."""
    return lists.select("product_id", F.posexplode("images").alias("sort_order", "url"))


def list_verdict(images: str) -> Column:
    """'ok', 'too_many' or 'invalid' for a list of images; null is no list and ok."""
    held = F.coalesce(F.col(images), F.array().cast("array<string>"))
    return F.when(F.size(held) > MOST, "too_many").when(~F.forall(held, image_is_valid), "invalid").otherwise("ok")


def replace_images(images: DataFrame, changes: DataFrame) -> DataFrame:
    """images (product_id, sort_order, url; one for each place) after changes (product_id, images; one for each product), merged by product and
    place: product_id, sort_order, url, action. A change with a null list or one that is refused keeps all; an empty list
    removes all. Actions: keep (not asked, or the same url), change, add, remove (with the url that goes)."""
    taken = changes.filter(F.col("images").isNotNull() & (list_verdict("images") == "ok"))
    new = image_rows(taken).withColumnRenamed("url", "new_url")
    asked = taken.select("product_id", F.lit(True).alias("asked"))
    rows = images.join(new, ["product_id", "sort_order"], "full_outer").join(asked, "product_id", "left")
    action = F.when(F.col("asked").isNull() | F.col("url").eqNullSafe(F.col("new_url")), "keep").when(F.col("new_url").isNull(), "remove").when(F.col("url").isNull(), "add").otherwise("change")
    return rows.select("product_id", "sort_order", F.coalesce("new_url", "url").alias("url"), action.alias("action"))


def first_images(images: DataFrame) -> DataFrame:
    """(product_id, image, images): the url of the smallest place and the number of images of each product that has any."""
    return images.groupBy("product_id").agg(F.min_by("url", "sort_order").alias("image"), F.count("*").alias("images"))


def product_cards(m: Market) -> DataFrame:
    """Listed products with their first image or null, as lists show them."""
    first = first_images(m.product_image).withColumnRenamed("product_id", "id")
    return listed(m).join(first, "id", "left").select("id", "title", "store_name", F.col("base_price").cast("double").alias("base_price"), "image", F.coalesce("images", F.lit(0)).alias("images"))


def asked_lists(m: Market) -> DataFrame:
    """Every seventh product asks for a new list, by its key of none to nine images; every fifth of these has a url that isn't allowed,
    every fourth leaves its images as they are."""
    key = F.col("id")
    url = lambda k: F.concat(F.when(key % 5 == 0, "ftp://x/").when(key % 3 == 0, "https://cdn.example/").otherwise("/img/"), key, F.lit("/"), k, F.lit(".jpg"))
    places = F.filter(F.sequence(F.lit(-1), (key % 10 - 1).cast("int")), lambda k: k >= 0)
    return m.product.filter("id % 7 = 3").select(key.alias("product_id"), F.when(key % 4 != 0, F.transform(places, url)).alias("images"))


def product_images_replace(m: Market) -> DataFrame:
    return replace_images(m.product_image.select("product_id", "sort_order", "url"), asked_lists(m))


def product_images_create(m: Market) -> DataFrame:
    """The verdict on each list that is asked for, and the images that a new product gets from it."""
    lists = asked_lists(m).withColumn("verdict", list_verdict("images"))
    rows = image_rows(lists.filter("verdict = 'ok'"))
    return lists.select("product_id", "verdict", F.size(F.coalesce("images", F.array().cast("array<string>"))).alias("asked")).join(rows, "product_id", "left").select("product_id", "verdict", "asked", "sort_order", "url")
