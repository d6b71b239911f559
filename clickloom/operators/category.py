"""Revenue and conversion of categories and brands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab


def _counts(ev: DataFrame, revenue: Column, priced: Column) -> DataFrame:
    return ev.groupBy(C.category(ev).alias("raw_category")).agg(
        C.n_type(ev, vocab.VIEW).alias("total_views"),
        C.n_type(ev, vocab.CART).alias("total_carts"),
        C.n_type(ev, vocab.PURCHASE).alias("total_purchases"),
        F.coalesce(C.amount(revenue), F.lit(0.0)).alias("total_revenue"),
        C.ratio(revenue, priced, 2).alias("avg_purchase_price"),
    )


def category_counts(ev: DataFrame) -> DataFrame:
    """Events, revenue and mean price per category code."""
    return _counts(ev, C.revenue(ev), C.n_priced(ev))


def category_performance(ev: DataFrame, min_views: int = 10_000) -> DataFrame:
    views, carts, purchases = F.col("total_views"), F.col("total_carts"), F.col("total_purchases")
    return (
        category_counts(ev)
        .where(views > min_views)
        .select(
            vocab.display_name(F.col("raw_category"), vocab.CATEGORY_NAMES).alias("category"),
            "total_views",
            "total_carts",
            "total_purchases",
            "total_revenue",
            "avg_purchase_price",
            C.pct(carts, views).alias("view_to_cart_pct"),
            C.pct(purchases, carts).alias("cart_to_purchase_pct"),
            C.pct(purchases, views).alias("view_to_purchase_pct"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def category_performance_priced(ev: DataFrame, min_views: int = 10_000) -> DataFrame:
    """Variant that drops unpriced carts and purchases as rows instead of inside the sums."""
    price = F.when(C.is_type(vocab.PURCHASE), F.col("price"))
    counts = _counts(ev.where((F.col("price") > 0) | C.is_type(vocab.VIEW)), F.sum(C.money(price)), F.count(price))
    views, purchases = F.col("total_views"), F.col("total_purchases")
    return (
        counts.where(views > min_views)
        .withColumn("view_to_purchase_pct", C.pct(purchases, views))
        .withColumnRenamed("raw_category", "top_category")
        .orderBy(F.desc("total_revenue"), "top_category")
    )


def brand_ranking(ev: DataFrame, min_purchases: int = 100, n: int = 30) -> DataFrame:
    """Brands by revenue. Reduced per (brand, category) first, which also counts the categories."""
    cells = (
        ev.where(F.col("brand").isNotNull())
        .groupBy("brand", C.category(ev).alias("raw_category"))
        .agg(
            C.n_type(ev, vocab.VIEW).alias("views"),
            C.n_type(ev, vocab.PURCHASE).alias("purchases"),
            C.revenue(ev).alias("revenue"),
            C.n_priced(ev).alias("priced"),
        )
    )
    return (
        cells.groupBy("brand")
        .agg(
            F.sum("purchases").alias("total_purchases"),
            F.coalesce(C.amount(F.sum("revenue")), F.lit(0.0)).alias("total_revenue"),
            C.ratio(F.sum("revenue"), F.sum("priced"), 2).alias("avg_purchase_price"),
            F.count("*").alias("category_count"),
            C.pct(F.sum("purchases"), F.sum("views")).alias("view_to_purchase_pct"),
        )
        .where(F.col("total_purchases") > min_purchases)
        .orderBy(F.desc("total_revenue"), "brand")
        .limit(n)
    )


def top_brands_in_top_categories(ev: DataFrame, categories: int = 5, brands: int = 10) -> DataFrame:
    """The best brands inside the categories with the highest revenue.

    One aggregate per (category, brand) feeds both steps; the rank filter lets
    Spark cut each category to its best brands before the shuffle.
    """
    cells = (
        ev.where(C.is_priced_purchase())
        .groupBy(C.top_category().alias("raw_category"), "brand")
        .agg(F.count("*").alias("total_purchases"), F.sum(C.money(F.col("price"))).alias("revenue"))
    )
    leaders = (
        cells.groupBy("raw_category")
        .agg(F.sum("revenue").alias("cat_revenue"))
        .orderBy(F.desc("cat_revenue"), "raw_category")
        .limit(categories)
        .select("raw_category")
    )
    branded = (
        cells.where(F.col("brand").isNotNull())
        .join(F.broadcast(leaders), "raw_category", "left_semi")  # at most `categories` rows
        .select(
            "raw_category",
            "brand",
            "total_purchases",
            C.amount(F.col("revenue")).alias("total_revenue"),
            C.ratio(F.col("revenue"), F.col("total_purchases"), 2).alias("avg_purchase_price"),
        )
    )
    rank = F.row_number().over(W.partitionBy("raw_category").orderBy(F.desc("total_revenue"), "brand"))
    return (
        branded.withColumn("brand_rank", rank)
        .where(F.col("brand_rank") <= brands)
        .select(
            vocab.display_name(F.col("raw_category"), vocab.CATEGORY_NAMES).alias("category"),
            "brand",
            "brand_rank",
            "total_purchases",
            "total_revenue",
            "avg_purchase_price",
        )
        .orderBy(F.desc("total_revenue"), "brand_rank", "category")
    )


def monthly_category_trend(ev: DataFrame, n: int = 8) -> DataFrame:
    """Monthly revenue of the categories with the highest total revenue."""
    monthly = (
        ev.where(C.is_priced_purchase())
        .groupBy(C.top_category().alias("raw_category"), C.year_month().alias("month"))
        .agg(F.sum(C.money(F.col("price"))).alias("revenue"), F.count("*").alias("purchase_count"))
    )
    leaders = (
        monthly.groupBy("raw_category")
        .agg(F.sum("revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), "raw_category")
        .limit(n)
        .select("raw_category")
    )
    return (
        monthly.join(F.broadcast(leaders), "raw_category", "left_semi")  # at most n rows
        .select(
            vocab.display_name(F.col("raw_category"), vocab.CATEGORY_NAMES).alias("category"),
            "month",
            C.amount(F.col("revenue")).alias("monthly_revenue"),
            "purchase_count",
        )
        .orderBy("month", F.desc("monthly_revenue"), "category")
    )
