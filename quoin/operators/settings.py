"""Settings as JSON values in a key-value table: read by type, with defaults, and updated by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import rules
from quoin.sources.market import DELIVERY_FEE, PLATFORM_RATE, Market

#: The settings that are numbers, with their defaults.
DEFAULTS = {"commission_rate": float(PLATFORM_RATE), "delivery_fee": float(DELIVERY_FEE)}


def json_type(value: Column) -> Column:
    """What a JSON text holds: number, string, boolean, object, array or null; null for a null or broken text."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    of = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), "number").when(kind.startswith("STRING"), "string").when(kind.startswith("BOOLEAN"), "boolean")
    return of.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.startswith("VOID"), "null")


def json_number(value: Column) -> Column:
    """The number that a JSON text is; null for any other type, a string of digits included."""
    return F.when(json_type(value) == "number", F.try_variant_get(F.try_parse_json(value), "$", "double"))


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table (key, value) after changes (key, value, seq): the newest change of each key replaces its value or adds it."""
    newest = changes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return table.join(newest, "key", "left_anti").select("key", "value").unionByName(newest)


def typed(table: DataFrame, defaults: dict[str, float] = DEFAULTS) -> DataFrame:
    """One row with a column for each default: the key's number, or the default where it is missing or isn't a number."""
    pick = lambda key, default: F.coalesce(F.max(F.when(F.col("key") == key, json_number(F.col("value")))), F.lit(default)).alias(key)
    return table.agg(*[pick(k, v) for k, v in defaults.items()])


def setting_changes(m: Market) -> DataFrame:
    """Error events as changes to settings (id, key, value, seq): their props' number as it is, with an exponent, as a string or inside
    its object, a null, and broken text, by their keys."""
    k, n = F.col("event_id"), F.regexp_extract("props", "([0-9]+)", 1)
    key = F.when(k % 4 == 3, F.concat(F.lit("banner_"), k % 50)).otherwise(F.element_at(F.array(F.lit("commission_rate"), F.lit("delivery_fee"), F.lit("support_phone")), (k % 3 + 1).cast("int")))
    value = F.element_at(F.array(n, F.concat(n, F.lit("e-2")), F.concat(F.lit('"'), n, F.lit('"')), F.col("props"), F.lit("null"), F.concat(F.lit("{"), n), F.concat(F.lit("-"), n, F.lit(".50"))), (k % 7 + 1).cast("int"))
    return m.raw("events").filter("event_type = 'error'").select(k.alias("id"), key.alias("key"), value.alias("value"), F.struct("ts", k.alias("id")).alias("seq"))


def platform_settings(m: Market) -> DataFrame:
    """The settings table: the newest value of each key among the changes with even ids."""
    none = m.spark.createDataFrame([], "key string, value string")
    return upsert(none, setting_changes(m).filter("id % 2 = 0"))


def settings(m: Market) -> DataFrame:
    return typed(platform_settings(m))


def settings_update(m: Market) -> DataFrame:
    """The table after the changes with odd ids, which come later."""
    return upsert(platform_settings(m), setting_changes(m).filter("id % 2 = 1"))


def setting_types(m: Market) -> DataFrame:
    """Each change with its value's type, its number, and the number that readers get from it."""
    default = F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])[F.col("key")]
    number = json_number(F.col("value"))
    return setting_changes(m).select("id", "key", json_type(F.col("value")).alias("type"), number.alias("number"), F.coalesce(number, default).alias("read_as"))


def settings_in_force(m: Market) -> DataFrame:
    """What each vendor's new orders would be charged under the settings: the vendor's own rate, else the platform's."""
    now = F.broadcast(typed(platform_settings(m)))  # one row
    rate = F.coalesce(F.col("commission_rate"), F.least(F.greatest(F.col("platform_rate"), F.lit(0.0)), F.lit(1.0)).cast("decimal(5,4)"))
    rows = m.vendor.join(now.withColumnRenamed("commission_rate", "platform_rate"))
    return rows.select("id", rate.cast("double").alias("rate"), rules.commission_amount(F.lit(100000).cast("decimal(12,2)"), rate).cast("double").alias("on_100000"), "delivery_fee")
