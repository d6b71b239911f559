"""Unusual prices, sessions and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab
from clickloom.functions.quantiles import quantiles, value_counts
from clickloom.sources.stable import written


def _price_counts(ev: DataFrame) -> DataFrame:
    """Purchases per (category, price): everything the outlier tables need, in one pass over the events."""
    bought = ev.where(C.is_priced_purchase()).select(C.top_category().alias("top_category"), "price")
    return value_counts(bought, ["top_category"], "price")


def _quartiles(counts: DataFrame) -> DataFrame:
    """Quartiles, count and maximum of purchase prices per category.

    Written once: it is small, and its real size then decides how it is joined.
    """
    totals = counts.groupBy("top_category").agg(F.sum("n").alias("total_purchases"), F.max("price").alias("max_price"))
    both = totals.join(quantiles(counts, ["top_category"], "price", [0.25, 0.75]), "top_category")
    return written(
        both.select("top_category", "total_purchases", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "max_price"),
        "price-quartiles",
    )


def _fence():
    return F.col("q3") + (F.col("q3") - F.col("q1")) * 1.5


def price_outlier_summary(ev: DataFrame) -> DataFrame:
    """Purchases above Q3 + 1.5 IQR per category, counted against the rounded fence. Runs Spark jobs when called."""
    prices = _price_counts(ev)
    stats = _quartiles(prices).withColumn("upper_fence", F.round(_fence(), 2))
    counts = (
        prices.join(stats.select("top_category", "upper_fence"), "top_category")
        .where(F.col("price") > F.col("upper_fence"))
        .groupBy("top_category")
        .agg(F.sum("n").alias("_outliers"))
    )
    outliers = F.coalesce(F.col("_outliers"), F.lit(0).cast("long"))
    return (
        stats.join(counts, "top_category", "left")
        .select(
            "top_category",
            "total_purchases",
            F.round("q1", 2).alias("q1"),
            F.round("q3", 2).alias("q3"),
            F.round(F.col("q3") - F.col("q1"), 2).alias("iqr"),
            "upper_fence",
            F.round("max_price", 2).alias("max_price"),
            outliers.alias("outlier_count"),
            C.pct(outliers, F.col("total_purchases"), 3).alias("outlier_pct"),
            C.ratio(F.round("max_price", 2), F.col("upper_fence"), 1).alias("max_to_fence_ratio"),
        )
        .orderBy(F.desc("outlier_count"), "top_category")
    )


def price_outliers(ev: DataFrame, n: int = 100) -> DataFrame:
    """The most expensive purchases above the unrounded fence of their category. Runs Spark jobs when called."""
    stats = _quartiles(_price_counts(ev)).select("top_category", "q1", "q3")
    order = C.tie_order(ev)
    flagged = (
        ev.where(C.is_type(vocab.PURCHASE))
        .withColumn("top_category", C.top_category())
        .join(stats, "top_category")
        .where(F.col("price") > _fence())
        .orderBy(F.desc("price"), *order)
        .limit(n)
    )
    return flagged.select(
        "user_id",
        "user_session",
        C.event_date().alias("purchase_date"),
        "top_category",
        "brand",
        "product_id",
        F.round("price", 2).alias("price"),
        F.round("q3", 2).alias("q3"),
        F.round(_fence(), 2).alias("upper_fence"),
        C.ratio(F.col("price"), _fence(), 1).alias("price_to_fence_ratio"),
    )


def busy_sessions(ev: DataFrame, min_events: int = 500) -> DataFrame:
    """(user_id, user_session, events, purchases) of sessions too long for a human."""
    counted = ev.groupBy("user_id", "user_session").agg(
        C.n_events(ev).alias("events"), C.n_type(ev, vocab.PURCHASE).alias("purchases")
    )
    return counted.where(F.col("events") > min_events)


def high_frequency_sessions(ev: DataFrame, min_events: int = 500) -> DataFrame:
    """Sessions too long for a human.

    Events are counted per session first; only those of the few long sessions are then reduced per (session, product).
    Runs a Spark job when called: the long sessions are written, so that Spark knows how few they are.
    """
    busy = busy_sessions(ev, min_events)
    busy = written(busy.select(F.col("user_id").alias("_user"), F.col("user_session").alias("_session")), "long-sessions")
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("user_session").eqNullSafe(F.col("_session"))
    ev = ev.join(busy, same, "left_semi")
    price = F.when(C.is_type(vocab.PURCHASE), F.col("price")).otherwise(F.lit(0.0))
    by_product = ev.groupBy("user_id", "user_session", "product_id").agg(
        F.count("*").alias("events"),
        C.count_type(vocab.PURCHASE).alias("purchases"),
        F.sum(C.money(price)).alias("revenue"),
        F.min("event_time").alias("first"),
        F.max("event_time").alias("last"),
        *[C.has_type(t).alias(f"has_{t}") for t in vocab.EVENT_TYPES],
    )
    types = sum((F.max(f"has_{t}") for t in vocab.EVENT_TYPES), F.lit(0))
    minutes = F.timestamp_diff("MINUTE", F.min("first"), F.max("last"))
    return (
        by_product.groupBy("user_id", "user_session")
        .agg(
            F.sum("events").alias("events_in_session"),
            F.count("product_id").alias("distinct_products"),
            types.alias("distinct_event_types"),
            F.sum("purchases").alias("purchases"),
            C.amount(F.sum("revenue")).alias("session_revenue"),
            F.to_date(F.min("first")).alias("session_date"),
            F.round(minutes.cast("double"), 1).alias("session_duration_minutes"),
        )
        .where(F.col("events_in_session") > min_events)
        .orderBy(F.desc("events_in_session"), "user_id", "user_session")
    )


def daily_volume(ev: DataFrame) -> DataFrame:
    return ev.groupBy(C.day(ev).alias("event_date")).agg(C.n_events(ev).alias("daily_events"))


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def daily_zscore(
    daily: DataFrame, value: str, days: int = 7, sigmas: float = 2.0, digits: int | None = 0
) -> DataFrame:
    """Compare each day with the days before it. The window runs over one row per day.

    Mean and deviation are rounded to ``digits`` first and the score uses the rounded values: whole numbers for
    counts, as in the published results; None leaves them as they are, for amounts of money.
    """
    before = W.orderBy("event_date").rowsBetween(-days, -1)
    rolling = daily.select(
        "event_date",
        value,
        _rounded(F.avg(value).over(before), digits).alias(f"rolling_{days}d_avg"),
        _rounded(F.stddev_samp(value).over(before), digits).alias(f"rolling_{days}d_stddev"),
    )
    mean, deviation = F.col(f"rolling_{days}d_avg"), F.col(f"rolling_{days}d_stddev")
    score = C.ratio(F.col(value) - mean, deviation)
    return (
        rolling.withColumn("z_score", F.round(score, 2))
        .withColumn(
            "anomaly_flag",
            F.when(mean.isNull(), vocab.FLAG_NO_HISTORY)
            .when(score < -sigmas, vocab.FLAG_LOW)
            .when(score > sigmas, vocab.FLAG_HIGH)
            .otherwise(vocab.FLAG_NORMAL),
        )
        .orderBy("event_date")
    )


def daily_volume_zscore(ev: DataFrame, days: int = 7, sigmas: float = 2.0) -> DataFrame:
    return daily_zscore(daily_volume(ev), "daily_events", days, sigmas)


def weekly_category_shift(ev: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Weekly revenue of a few categories, to date a relabeling of products."""
    names = names or vocab.CATEGORY_NAMES_WEEKLY
    weekly = (
        ev.where(C.holds_priced(ev) & C.category(ev).isin(list(names)))
        .groupBy(C.week(ev).alias("week_start"), C.category(ev).alias("raw_category"))
        .agg(C.n_priced(ev).alias("purchase_count"), C.amount(C.revenue(ev)).alias("weekly_revenue"))
    )
    return weekly.orderBy("week_start", "raw_category").select(
        "week_start",
        vocab.display_name(F.col("raw_category"), names).alias("category"),
        "purchase_count",
        "weekly_revenue",
    )


def _in_band(ev: DataFrame, low: float, high: float) -> DataFrame:
    return ev.where(C.is_type(vocab.PURCHASE) & F.col("price").between(low, high))


def repeat_cap_purchases(ev: DataFrame, low: float = 2573.0, high: float = 2575.0) -> DataFrame:
    """Users buying the same product more than once inside a price band."""
    day = C.event_date()
    return (
        _in_band(ev, low, high)
        .groupBy("user_id", "product_id")
        .agg(
            F.count("*").alias("times_at_cap"),
            F.min(day).alias("first_occurrence"),
            F.max(day).alias("last_occurrence"),
            F.date_diff(F.max(day), F.min(day)).alias("days_between"),
            F.countDistinct("user_session").alias("distinct_sessions"),
        )
        .where(F.col("times_at_cap") > 1)
        .orderBy(F.desc("times_at_cap"), F.desc("days_between"), "user_id", "product_id")
    )


def cap_concentration(ev: DataFrame, low: float = 2573.0, high: float = 2575.0) -> DataFrame:
    """Purchases inside a price band, and how many people made them."""
    per_user = _in_band(ev, low, high).groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_capped_transactions"),
        F.count("user_id").alias("distinct_users"),
        C.ratio(F.sum("n"), F.count("user_id"), 2).alias("avg_capped_purchases_per_user"),
    )


def lowest_volume_days(ev: DataFrame, n: int = 20) -> DataFrame:
    days = daily_volume(ev).withColumnRenamed("daily_events", "events")
    return days.orderBy("events", "event_date").limit(n)
