"""Clickstream and purchase histories derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import vocab
from clickloom.operators.sessions import sessionize
from clickloom.sources.stable import stored_once

# Schemas of the test tables; stating them saves a job that would look into the files.
EVENTS_TABLE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PART_TABLE = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
ORDERS_TABLE = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string"
)
LINEITEM_TABLE = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)

# How the test tables stand for shop data: event types, and a category per part type.
EVENT_TYPES = {"view": vocab.VIEW, "click": vocab.CART, "purchase": vocab.PURCHASE}
PART_CATEGORIES = {
    "ECONOMY": "electronics",
    "STANDARD": "appliances",
    "MEDIUM": "construction",
    "PROMO": "apparel",
    "LARGE": "computers",
    "SMALL": "sport",
}
SESSION_GAP_SECONDS = 24 * 3600


def typed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Time and type of all events, for load checks: also of those types that the shop has no use for."""
    raw = spark.read.schema(EVENTS_TABLE).parquet(f"{folder}/events.parquet")
    return raw.select(
        F.col("ts").cast("timestamp").alias("event_time"),
        vocab.display_name(F.col("event_type"), {"click": vocab.CART}).alias("event_type"),
    )


def base_events(spark: SparkSession, folder: str) -> DataFrame:
    """Shop events with user, product, price and time; neither session nor product attributes.

    The test table also holds sign-ups and errors, which are no shop events; ``typed_events`` has them.
    """
    raw = spark.read.schema(EVENTS_TABLE).parquet(f"{folder}/events.parquet")
    return raw.where(F.col("event_type").isin(list(EVENT_TYPES))).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        vocab.display_name(F.col("event_type"), {"click": vocab.CART}).alias("event_type"),
        F.get_json_object("props", "$.k").cast("long").alias("product_id"),
        F.col("value").alias("price"),
        "user_id",
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """Category and brand per product. Some products have none, as in real data."""
    part = spark.read.schema(PART_TABLE).parquet(f"{folder}/part.parquet")
    code = vocab.display_name(F.col("p_type"), PART_CATEGORIES)
    shape = F.split("p_name", " ")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_size").cast("long").alias("category_id"),
        F.when(shape[0] != "hot", F.concat(code, F.lit("."), shape[1])).alias("category_code"),
        F.when(shape[1] != "gizmo", F.lower("p_brand")).alias("brand"),
    )


def product_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with product attributes but without sessions.

    No join hint: Spark compares the real size of the product file with its
    broadcast threshold.
    """
    return base_events(spark, folder).join(products(spark, folder), "product_id", "left")


def session_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with sessions but without product attributes."""
    return sessionize(base_events(spark, folder), SESSION_GAP_SECONDS)


def full_events(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of the events table."""
    return session_events(spark, folder).join(products(spark, folder), "product_id", "left")


def event_files(folder: str) -> list[str]:
    """What ``full_events`` reads."""
    return [f"{folder}/events.parquet", f"{folder}/part.parquet"]


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    """All columns, for operators that read the events more than once: derived and written once in a session."""
    return stored_once(spark, event_files(folder), "events", lambda: full_events(spark, folder))


def stored_session_events(spark: SparkSession, folder: str) -> DataFrame:
    return stored_once(spark, event_files(folder)[:1], "session-events", lambda: session_events(spark, folder))


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as purchases over several years, for monthly and per-customer operators."""
    orders = spark.read.schema(ORDERS_TABLE).parquet(f"{folder}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.lit(vocab.PURCHASE).alias("event_type"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").cast("string").alias("user_session"),
    )


def lineitem_events(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as purchases of parts, for price statistics at volume."""
    items = spark.read.schema(LINEITEM_TABLE).parquet(f"{folder}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.lit(vocab.PURCHASE).alias("event_type"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_orderkey").cast("string").alias("user_session"),
    )
    return items.join(products(spark, folder), "product_id", "left")
