"""Before/after comparison around a known date, and its statistics."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import periods, vocab
from clickloom.functions.periods import PeriodSpec

DEFAULT = PeriodSpec()


def assign_period(ev: DataFrame, spec: PeriodSpec = DEFAULT, with_transition: bool = False) -> DataFrame:
    """Add ``period``; rows outside both periods and on excluded days are dropped."""
    label = spec.label(C.day(ev), with_transition)
    return ev.where(spec.kept(C.day(ev)) & label.isNotNull()).withColumn("period", label)


def _revenue():
    return F.when(C.is_priced_purchase(), F.col("price"))


def period_funnel(ev: DataFrame, spec: PeriodSpec = DEFAULT) -> DataFrame:
    """Events, revenue and converting sessions per period, from one aggregate per (period, session)."""
    sessions = (
        assign_period(ev, spec)
        .groupBy("period", "user_session")
        .agg(
            C.n_type(ev, vocab.VIEW).alias("views"),
            C.n_type(ev, vocab.CART).alias("carts"),
            C.n_type(ev, vocab.PURCHASE).alias("purchases"),
            C.revenue(ev).alias("revenue"),
            C.n_priced(ev).alias("priced"),
        )
    )
    views, carts, purchases = F.col("total_views"), F.col("total_carts"), F.col("total_purchases")
    named_buyer = (F.col("purchases") > 0) & F.col("user_session").isNotNull()
    return (
        sessions.groupBy("period")
        .agg(
            F.sum("views").alias("total_views"),
            F.sum("carts").alias("total_carts"),
            F.sum("purchases").alias("total_purchases"),
            C.amount(F.sum("revenue")).alias("total_revenue"),
            C.ratio(F.sum("revenue"), F.sum("priced"), 2).alias("avg_order_value"),
            F.count("user_session").alias("total_sessions"),
            F.count_if(named_buyer).alias("purchase_sessions"),
        )
        .select(
            "period",
            "total_views",
            "total_carts",
            "total_purchases",
            "total_revenue",
            "avg_order_value",
            C.pct(carts, views, 4).alias("view_to_cart_pct"),
            C.pct(purchases, carts, 4).alias("cart_to_purchase_pct"),
            C.pct(purchases, views, 4).alias("view_to_purchase_pct"),
            "total_sessions",
            "purchase_sessions",
            C.pct(F.col("purchase_sessions"), F.col("total_sessions"), 4).alias("session_conversion_pct"),
        )
        .orderBy(F.desc("period"))
    )


def weekly_trend(ev: DataFrame, spec: PeriodSpec = DEFAULT) -> DataFrame:
    """Weekly conversion; a week cut by a period boundary has one row per period."""
    sessions = (
        ev.where(spec.kept(C.day(ev)))
        .groupBy(C.week(ev).alias("week_start"), spec.label(C.day(ev), True).alias("period"), "user_session")
        .agg(C.n_type(ev, vocab.VIEW).alias("views"), C.n_type(ev, vocab.PURCHASE).alias("purchases"))
    )
    named_buyer = (F.col("purchases") > 0) & F.col("user_session").isNotNull()
    out = sessions.groupBy("week_start", "period").agg(
        F.sum("views").alias("weekly_views"),
        F.sum("purchases").alias("weekly_purchases"),
        F.count("user_session").alias("weekly_sessions"),
        F.count_if(named_buyer).alias("purchase_sessions"),
    )
    return (
        out.withColumn("view_to_purchase_pct", C.pct(F.col("weekly_purchases"), F.col("weekly_views"), 4))
        .withColumn("session_conversion_pct", C.pct(F.col("purchase_sessions"), F.col("weekly_sessions"), 4))
        .orderBy("week_start", "period")
    )


def category_mix(ev: DataFrame, spec: PeriodSpec = periods.CATEGORY_PERIODS) -> DataFrame:
    """Share of revenue per category code and period. The share's window runs over one row per category."""
    revenue = (
        assign_period(ev.where(C.holds_priced(ev)), spec)
        .groupBy("period", C.category(ev).alias("raw_category"))
        .agg(C.amount(C.revenue(ev)).alias("category_revenue"), C.n_priced(ev).alias("purchase_count"))
    )
    total = F.sum("category_revenue").over(W.partitionBy("period"))
    return revenue.withColumn("revenue_share_pct", C.pct(F.col("category_revenue"), total))


def category_mix_shift(ev: DataFrame, spec: PeriodSpec = periods.CATEGORY_PERIODS) -> DataFrame:
    """``category_mix`` with display names, in report order."""
    return (
        category_mix(ev, spec)
        .select(
            "period",
            vocab.display_name(F.col("raw_category"), vocab.CATEGORY_NAMES_STARRED).alias("category"),
            "category_revenue",
            "purchase_count",
            "revenue_share_pct",
        )
        .orderBy("period", F.desc("category_revenue"), "category")
    )


def period_session_behavior(ev: DataFrame, spec: PeriodSpec = DEFAULT) -> DataFrame:
    """Depth and value of sessions. Reduced per (period, session, product) first, which also counts the products."""
    cells = (
        assign_period(ev, spec)
        .groupBy("period", "user_session", "product_id")
        .agg(
            F.count("*").alias("events"),
            C.has_type(vocab.PURCHASE).alias("bought"),
            F.sum(C.money(_revenue())).alias("revenue"),
        )
    )
    sessions = cells.groupBy("period", "user_session").agg(
        F.sum("events").alias("events"),
        F.count("product_id").alias("products"),
        F.max("bought").alias("bought"),
        F.round(F.sum("revenue"), 2).alias("revenue"),
    )
    return (
        sessions.groupBy("period")
        .agg(
            F.count("*").alias("total_sessions"),
            F.round(F.avg("events"), 2).alias("avg_events_per_session"),
            F.round(F.avg("products"), 2).alias("avg_products_viewed"),
            F.sum("bought").alias("purchase_sessions"),
            C.pct(F.sum("bought"), F.count("*"), 4).alias("session_purchase_rate_pct"),
            C.exact_mean(F.when(F.col("bought") == 1, F.col("revenue"))).alias("avg_session_revenue"),
        )
        .orderBy(F.desc("period"))
    )


def new_vs_returning(ev: DataFrame, spec: PeriodSpec = DEFAULT) -> DataFrame:
    """Buyers on their first purchase date against later ones; a buyer may appear on both sides.

    Purchases are reduced to one row per (user, day), so the window per user
    holds no more rows than the data has days.
    """
    days = (
        ev.where(C.holds_type(ev, vocab.PURCHASE))
        .groupBy("user_id", C.day(ev).alias("event_date"))
        .agg(C.n_priced(ev).alias("purchases"), C.revenue(ev).alias("revenue"))
    )
    first = F.min("event_date").over(W.partitionBy("user_id"))
    typed = days.withColumn(
        "buyer_type", F.when(F.col("event_date") == first, "New buyer").otherwise("Returning buyer")
    )
    in_period = assign_period(typed.where(F.col("purchases") > 0), spec)
    return (
        in_period.groupBy("period", "buyer_type", "user_id")
        .agg(F.sum("purchases").alias("purchases"), F.sum("revenue").alias("revenue"))
        .groupBy("period", "buyer_type")
        .agg(
            F.count("*").alias("unique_buyers"),
            F.sum("purchases").alias("total_purchases"),
            C.amount(F.sum("revenue")).alias("total_revenue"),
            C.ratio(F.sum("revenue"), F.sum("purchases"), 2).alias("avg_order_value"),
        )
        .orderBy(F.desc("period"), "buyer_type")
    )


def period_session_conversion(ev: DataFrame, split: date = date(2020, 3, 1)) -> DataFrame:
    """Plain two-way split at one date."""
    period = F.when(C.event_date() < F.lit(split), "pre_covid").otherwise("covid_onset").alias("period")
    sessions = ev.groupBy(period, "user_session").agg(C.has_type(vocab.PURCHASE).alias("converted"))
    return (
        sessions.groupBy("period")
        .agg(
            F.count("*").alias("total_sessions"),
            F.sum("converted").alias("converted_sessions"),
            C.pct(F.sum("converted"), F.count("*"), 4).alias("conversion_rate_pct"),
        )
        .orderBy("period")
    )


def _side_by_side(funnel: DataFrame, spec: PeriodSpec) -> DataFrame:
    """Successes and trials of both periods in one row."""

    def of(period: str, column: str):
        return F.max(F.when(F.col("period") == period, F.col(column)))

    return funnel.agg(
        of(spec.onset_label, "purchase_sessions").cast("double").alias("x1"),
        of(spec.onset_label, "total_sessions").cast("double").alias("n1"),
        of(spec.pre_label, "purchase_sessions").cast("double").alias("x2"),
        of(spec.pre_label, "total_sessions").cast("double").alias("n2"),
    ).select(
        "n1", "n2", C.ratio(F.col("x1"), F.col("n1")).alias("p1"), C.ratio(F.col("x2"), F.col("n2")).alias("p2"),
        C.ratio(F.col("x1") + F.col("x2"), F.col("n1") + F.col("n2")).alias("pooled"),
    )


def upper_normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, as a column expression.

    Up to x = |z| / sqrt(2) = 3 by the power series of the error function, whose terms are all positive; beyond by the
    continued fraction of its complement. Both are good to some 14 digits with the numbers of terms used.
    """
    x = F.abs(z) / math.sqrt(2.0)
    square = x * x
    start = F.struct(x.alias("sum"), x.alias("term"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * square / (2.0 * n + 1.0)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, add, lambda acc: acc["sum"])
    near = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-square) * series
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda f, k: 1.0 + k / (2.0 * square * f))
    far = F.exp(-square) / (x * math.sqrt(math.pi) * fraction)
    half = F.when(x < 3.0, near).otherwise(far) / 2.0
    return F.when(z < 0, 1.0 - half).otherwise(half)


def two_proportion_ztest(funnel: DataFrame, spec: PeriodSpec = DEFAULT, alternative: str = "larger") -> DataFrame:
    """Pooled z-test that onset sessions convert more ('larger'), less ('smaller') or differently ('two-sided')."""
    p1, p2, pooled = F.col("p1"), F.col("p2"), F.col("pooled")
    error = F.sqrt(pooled * (1 - pooled) * (C.ratio(F.lit(1.0), F.col("n1")) + C.ratio(F.lit(1.0), F.col("n2"))))
    tail_of = {
        "larger": F.col("z_stat"),
        "smaller": -F.col("z_stat"),
        "two-sided": F.abs(F.col("z_stat")),
    }[alternative]
    sides = 2.0 if alternative == "two-sided" else 1.0
    return (
        _side_by_side(funnel, spec)
        .select(p1.alias("p_onset"), p2.alias("p_pre"), F.try_divide(p1 - p2, error).alias("z_stat"))
        .withColumn("p_value", upper_normal_tail(tail_of) * sides)
    )


def proportion_effect(funnel: DataFrame, spec: PeriodSpec = DEFAULT) -> DataFrame:
    """Difference in points with its 95% interval, relative change and Cohen's h."""
    p1, p2 = F.col("p1"), F.col("p2")
    error = F.sqrt(C.ratio(p1 * (1 - p1), F.col("n1")) + C.ratio(p2 * (1 - p2), F.col("n2")))
    return _side_by_side(funnel, spec).select(
        ((p1 - p2) * 100).alias("delta_pp"),
        F.try_divide((p1 - p2) * 100, p2).alias("relative_change_pct"),
        ((p1 - p2 - 1.96 * error) * 100).alias("ci_low_pp"),
        ((p1 - p2 + 1.96 * error) * 100).alias("ci_high_pp"),
        (2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))).alias("cohens_h"),
    )


def weekly_conversion_merged(weekly: DataFrame) -> DataFrame:
    """Join the parts of weeks cut by a boundary and mark the best week. Works on one row per week."""
    merged = weekly.groupBy("week_start").agg(
        F.sum("weekly_sessions").alias("weekly_sessions"),
        F.sum("purchase_sessions").alias("purchase_sessions"),
    )
    rate = C.pct(F.col("purchase_sessions"), F.col("weekly_sessions"), None)
    best = F.max_by("week_start", F.struct("rate", -F.datediff("week_start", F.lit(date(1970, 1, 1))))).over(W.partitionBy())
    return (
        merged.withColumn("rate", rate)
        .withColumn("is_peak", F.col("week_start") == best)
        .select(
            "week_start", "weekly_sessions", "purchase_sessions",
            F.round("rate", 6).alias("session_conversion_pct"), "is_peak",
        )
        .orderBy("week_start")
    )


def pct_change_from_baseline(df: DataFrame, metrics: list[str], spec: PeriodSpec = DEFAULT) -> DataFrame:
    """Relative change of every metric column between the two period rows of ``df``."""
    long = df.unpivot("period", [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")

    def of(period: str):
        return F.max(F.when(F.col("period") == period, F.col("value")))

    return (
        long.groupBy("metric")
        .agg(of(spec.pre_label).alias("pre_value"), of(spec.onset_label).alias("onset_value"))
        .withColumn(
            "pct_change", C.pct(F.col("onset_value") - F.col("pre_value"), F.col("pre_value"), 4)
        )
        .orderBy("metric")
    )


def category_share_delta(
    mix: DataFrame,
    spec: PeriodSpec = periods.CATEGORY_PERIODS,
    exclude: tuple[str, ...] = (vocab.CATEGORY_NAMES_STARRED["construction"],),
) -> DataFrame:
    """Shares of both periods side by side, without the categories whose label is unreliable."""
    shares = mix.groupBy("category").pivot("period", [spec.pre_label, spec.onset_label]).agg(F.first("revenue_share_pct"))
    return (
        shares.where(~F.col("category").isin(list(exclude)))
        .select(
            "category",
            F.col(f"`{spec.pre_label}`").alias("pre_pct"),
            F.col(f"`{spec.onset_label}`").alias("onset_pct"),
        )
        .withColumn("delta_pp", F.round(F.col("onset_pct") - F.col("pre_pct"), 2))
        .orderBy("onset_pct", "category")
    )


def period_days(ev: DataFrame, spec: PeriodSpec = DEFAULT) -> tuple[int, int]:
    """Days before and after the boundary that the data covers, from its first to its last day, less excluded ones.
    Runs a Spark job."""
    first, last = ev.agg(F.min(C.day(ev)), F.max(C.day(ev))).first()
    if first is None:
        return 0, 0

    def days(start: date, end: date) -> int:
        out = sum(start <= d <= end for d in set(spec.excluded))
        return max(0, (end - start).days + 1 - out)

    return days(max(first, spec.pre_start) if spec.pre_start else first, min(last, spec.pre_end)), days(max(first, spec.onset_start), last)


def buyer_mix_daily(
    mix: DataFrame,
    spec: PeriodSpec = DEFAULT,
    pre_days: int = periods.PRE_DAYS,
    onset_days: int = periods.ONSET_DAYS,
) -> DataFrame:
    """Composition, buyers per day and its change; works on the four rows of ``new_vs_returning``.

    The defaults are the published numbers of days; for other periods or data take them from ``period_days``.
    """
    total = F.sum("unique_buyers").over(W.partitionBy("period"))
    days = F.when(F.col("period") == spec.pre_label, float(pre_days)).otherwise(float(onset_days))
    daily = mix.select(
        "period",
        "buyer_type",
        C.pct(F.col("unique_buyers"), total, 4).alias("share_pct"),
        (F.col("unique_buyers") / days).alias("_per_day"),
    )
    before = F.max(F.when(F.col("period") == spec.pre_label, F.col("_per_day"))).over(W.partitionBy("buyer_type"))
    change = F.when(F.col("period") == spec.onset_label, C.pct(F.col("_per_day") - before, before, 4))
    return daily.select(
        "period",
        "buyer_type",
        "share_pct",
        F.round("_per_day", 4).alias("buyers_per_day"),
        change.alias("change_pct"),
    ).orderBy(F.desc("period"), "buyer_type")
