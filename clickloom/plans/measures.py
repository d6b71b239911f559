"""Named measures over the mart tables.

A measure with a ``by`` argument is re-evaluated per group, as a report would
under its filters. All inputs are mart tables of a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab


def _sums_ratio(table: DataFrame, num: str, den: str, name: str, by: Sequence[str]) -> DataFrame:
    return table.groupBy(*by).agg(C.ratio(F.sum(num), F.sum(den), 6).alias(name))


def weighted_avg_price(fact_category_performance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue per purchase over the selected categories."""
    return _sums_ratio(fact_category_performance, "TotalRevenue", "Purchases", "weighted_avg_price", by)


def brand_weighted_avg_price(fact_top_brands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue per purchase over the selected brands."""
    return _sums_ratio(fact_top_brands, "TotalRevenue", "Purchases", "brand_weighted_avg_price", by)


def category_purchase_volume_median(fact_category_performance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median number of purchases of the selected categories."""
    return fact_category_performance.groupBy(*by).agg(F.median("Purchases").alias("purchase_volume_median"))


def category_conversion_rate(fact_funnel_by_category: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Purchases per view over the selected categories."""
    return _sums_ratio(fact_funnel_by_category, "Purchases", "Views", "category_conversion_rate", by)


def brand_conversion_rate(fact_funnel_by_brand: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Purchases per view over the selected brands."""
    return _sums_ratio(fact_funnel_by_brand, "Purchases", "Views", "brand_conversion_rate", by)


def session_conversion_rate(fact_session_depth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of sessions with a purchase over the selected depth buckets."""
    return _sums_ratio(fact_session_depth, "PurchasingSessions", "TotalSessions", "session_conversion_rate", by)


def weighted_avg_retention(
    fact_cohort_retention: DataFrame, dim_cohort_month: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Mean retention after the first month, weighted by cohort size."""
    weighted = fact_cohort_retention.where(F.col("MonthsSinceFirst") != "M0").join(dim_cohort_month, "CohortMonth")
    users = F.col("CohortUsers")
    return weighted.groupBy(*by).agg(
        C.ratio(F.sum(F.col("RetentionRate") * users), F.sum(users), 6).alias("weighted_avg_retention")
    )


def weighted_outlier_rate(fact_price_outliers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of purchases above the price fence over the selected categories."""
    return _sums_ratio(fact_price_outliers, "OutlierCount", "TotalPurchases", "weighted_outlier_rate", by)


def weighted_avg_monetary(fact_rfm_segment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean lifetime spend, segments weighted by their share of users."""
    share = F.col("PctUsers")
    return fact_rfm_segment.groupBy(*by).agg(
        C.ratio(F.sum(F.col("AvgMonetary") * share), F.sum(share), 6).alias("weighted_avg_monetary")
    )


def sessions_grand_total(fact_converting_vs_non: DataFrame) -> DataFrame:
    """Sessions per type next to the total that ignores the type."""
    return fact_converting_vs_non.select(
        "SessionType", "Sessions", F.sum("Sessions").over(W.partitionBy()).alias("sessions_grand_total")
    )


def median_session_duration(fact_converting_vs_non: DataFrame, by: Sequence[str] = ("SessionType",)) -> DataFrame:
    """Median session duration as minutes and seconds."""
    minutes = fact_converting_vs_non.groupBy(*by).agg(F.avg("MedianDurationMin").alias("_minutes"))
    return minutes.select(*by, C.minutes_seconds(F.col("_minutes")).alias("median_session_duration"))


def _metric_text(metric: Column, value: Column) -> Column:
    """Each metric in its own unit."""
    money = F.concat(F.lit("$"), F.format_number(F.round(value, 1), 1))
    return (
        F.when(metric == "Session Conversion %", C.pct_text(value))
        .when(metric.isin("Avg Order Value ($)", "Avg Session Revenue ($)"), money)
        .otherwise(F.format_number(F.round(value, 1), 1))
    )


def covid_formatted(fact_covid_comparison: DataFrame) -> DataFrame:
    """Values of both periods as text, and their difference."""
    metric = F.col("Metric")
    return fact_covid_comparison.select(
        "Metric",
        _metric_text(metric, F.col("PreCovid")).alias("pre_period_formatted"),
        _metric_text(metric, F.col("CovidOnset")).alias("onset_period_formatted"),
        F.round(F.col("CovidOnset") - F.col("PreCovid"), 6).alias("onset_vs_pre_delta"),
    )


def overview_kpis(ev: DataFrame) -> DataFrame:
    """Headline numbers in one row, from one aggregate per session.

    The number of buyers needs a second grouping and is brought in as rows of
    the same shape, not by a join.
    """
    per_session = ev.groupBy("user_session").agg(
        C.n_events(ev).alias("events"),
        C.revenue(ev).alias("revenue"),
        *[C.has(ev, t).alias(t) for t in vocab.EVENT_TYPES],
    )
    named = F.col("user_session").isNotNull()

    def sessions_where(condition: Column) -> Column:
        return F.count_if(named & condition)

    carted, bought = F.col(vocab.CART) == 1, F.col(vocab.PURCHASE) == 1
    main = per_session.agg(
        F.sum("events").alias("total_events"),
        C.amount(F.sum("revenue"), None).alias("total_revenue"),
        sessions_where(F.col(vocab.VIEW) == 1).alias("view_sessions"),
        sessions_where(carted).alias("cart_sessions"),
        sessions_where(bought).alias("purchase_sessions"),
        sessions_where(carted & ~bought).alias("abandoned_sessions"),
    )
    buyers = (
        ev.where(C.holds_type(ev, vocab.PURCHASE))
        .select("user_id")
        .distinct()
        .agg(F.count("user_id").alias("purchasing_users"))
    )
    both = main.unionByName(buyers, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.select(
        "total_events",
        "purchasing_users",
        C.ratio(F.col("purchase_sessions"), F.col("view_sessions"), 6).alias("overall_conversion_rate"),
        F.round("total_revenue", 2).alias("total_revenue"),
        C.ratio(F.col("abandoned_sessions"), F.col("cart_sessions"), 6).alias("cart_abandonment_rate"),
        "abandoned_sessions",
        "purchase_sessions",
    )


def per_buyer(kpis: DataFrame) -> DataFrame:
    """Events and revenue per buyer."""
    buyers = F.col("purchasing_users")
    return kpis.select(
        C.ratio(F.col("total_events"), buyers, 4).alias("events_per_buyer"),
        C.ratio(F.col("total_revenue"), buyers, 4).alias("revenue_per_buyer"),
    )


def cart_abandonment_opportunity(kpis: DataFrame) -> DataFrame:
    """Value of abandoned sessions, had each been worth a purchase session's mean revenue."""
    mean = C.ratio(F.col("total_revenue"), F.col("purchase_sessions"))
    return kpis.select(F.round(F.col("abandoned_sessions") * mean, 2).alias("cart_abandonment_opportunity"))


def champion_share(fact_rfm_segment: DataFrame) -> DataFrame:
    """Champions' share of revenue, and how many times their share of users that is."""

    def of_champions(column: str) -> Column:
        return F.sum(F.when(F.col("Segment") == "Champion", F.col(column)))

    return fact_rfm_segment.agg(
        of_champions("PctRevenue").alias("champion_revenue_share"),
        C.ratio(of_champions("PctRevenue"), of_champions("PctUsers"), 4).alias("champion_user_multiple"),
    )


def champion_revenue(fact_rfm_segment: DataFrame, segments: DataFrame) -> DataFrame:
    """Champions' share applied to the total revenue of all segments."""
    total = segments.agg(F.sum("monetary").alias("total"))
    share = champion_share(fact_rfm_segment).select("champion_revenue_share")
    both = total.unionByName(share, allowMissingColumns=True)
    one = both.agg(F.max("total").alias("total"), F.max("champion_revenue_share").alias("share"))
    return one.select(F.round(F.col("total") * F.col("share"), 2).alias("champion_revenue"))


def month1_retention(fact_retention_curve: DataFrame) -> DataFrame:
    """Mean share of buyers who come back in their second month."""
    return fact_retention_curve.where(F.col("MonthsSinceFirst") == "M1").select(
        F.col("AvgRetention").alias("month1_retention_avg")
    )


def retention_position(fact_retention_curve: DataFrame) -> DataFrame:
    """Where month-1 retention lies between its worst and its best cohort."""
    low, high = F.col("MinRetention"), F.col("MaxRetention")
    position = F.col("retention_position_ratio")
    tier = C.tier_bucket(position)
    # Text and colour per tier.
    text = (
        F.when(tier == "Low", "Toward the lower end of the historical cohort range")
        .when(tier == "High", "Toward the higher end of the historical cohort range")
        .otherwise("In the middle of the historical cohort range")
    )
    colour = F.when(tier == "Low", vocab.AMBER).when(tier == "High", vocab.GREEN).otherwise(vocab.BLUE)
    return (
        fact_retention_curve.where(F.col("MonthsSinceFirst") == "M1")
        .select(C.ratio(F.col("AvgRetention") - low, high - low, 6).alias("retention_position_ratio"))
        .select(
            "retention_position_ratio",
            tier.alias("retention_tier"),
            text.alias("retention_position_text"),
            colour.alias("retention_position_color"),
        )
    )


def conversion_lift(fact_covid_comparison: DataFrame) -> DataFrame:
    """Relative change of session conversion with its text and colour."""
    rate = fact_covid_comparison.where(F.col("Metric") == "Session Conversion %")
    lift = F.col("session_conversion_lift")
    # Text per direction.
    return rate.select(
        C.ratio(F.col("CovidOnset") - F.col("PreCovid"), F.col("PreCovid"), 6).alias("session_conversion_lift")
    ).select(
        "session_conversion_lift",
        F.when(lift >= 0, "Conversion rate improved after COVID-19 onset")
        .otherwise("Conversion rate declined after COVID-19 onset")
        .alias("direction_text"),
        F.when(lift >= 0, vocab.GREEN).otherwise(vocab.RED).alias("lift_color"),
    )


def _top(table: DataFrame, name: str, value: Column) -> DataFrame:
    return table.withColumn("_value", value).orderBy(F.desc("_value"), name).limit(1)


def depth_swing(fact_session_depth: DataFrame) -> DataFrame:
    """Conversion of the best depth bucket as a multiple of the worst."""
    rate = C.ratio(F.col("PurchasingSessions"), F.col("TotalSessions"))
    rates = fact_session_depth.select(rate.alias("rate"))
    return rates.agg(C.ratio(F.max("rate"), F.min("rate"), 4).alias("depth_swing"))


def top_converting_category(fact_funnel_by_category: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Best converting category with its display name and its mislabeled flag."""
    top = _top(fact_funnel_by_category, "CategoryCode", C.ratio(F.col("Purchases"), F.col("Views")))
    return top.join(dim_category, "CategoryCode", "left").select(
        F.col("CategoryCode").alias("top_category"),
        F.round("_value", 6).alias("conversion_rate"),
        F.col("DisplayName").alias("display_name"),
        (F.col("TaxonomyMislabeledFlag") == "Y").alias("is_mislabeled"),
    )


def _top_share(table: DataFrame, name: str, value: str) -> DataFrame:
    total = F.sum(value).over(W.partitionBy())
    shares = table.withColumn("_share", C.ratio(F.col(value), total, 6))
    return _top(shares, name, F.col(value))


def top_category_share(fact_category_performance: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Category with the highest revenue, its share of the categories shown, display name and mislabeled flag."""
    top = _top_share(fact_category_performance, "CategoryCode", "TotalRevenue")
    return top.join(dim_category, "CategoryCode", "left").select(
        F.col("CategoryCode").alias("top_category"),
        F.col("TotalRevenue").alias("revenue"),
        F.col("_share").alias("revenue_share"),
        F.col("DisplayName").alias("display_name"),
        (F.col("TaxonomyMislabeledFlag") == "Y").alias("is_mislabeled"),
    )


def top_brand_share(fact_top_brands: DataFrame) -> DataFrame:
    """Brand with the highest revenue and its share of the brands shown."""
    return _top_share(fact_top_brands, "Brand", "TotalRevenue").select(
        C.capitalised(F.col("Brand")).alias("top_brand"),
        F.col("TotalRevenue").alias("revenue"),
        F.col("_share").alias("revenue_share"),
    )


def top_segment(fact_rfm_segment: DataFrame) -> DataFrame:
    """Segment with the largest share of revenue, and revenue share per user share."""
    return _top(fact_rfm_segment, "Segment", F.col("PctRevenue")).select(
        F.col("Segment").alias("top_segment"),
        F.col("PctUsers").alias("user_share"),
        F.col("PctRevenue").alias("revenue_share"),
        C.ratio(F.col("PctRevenue"), F.col("PctUsers"), 4).alias("revenue_multiple"),
    )


def converting_gap(fact_converting_vs_non: DataFrame) -> DataFrame:
    """Events and carts of converting and other sessions in one row."""

    def of(kind: str, column: str) -> Column:
        return F.avg(F.when(F.col("SessionType") == kind, F.col(column)))

    return fact_converting_vs_non.agg(
        of("Converting", "AvgEvents").alias("converting_events"),
        of("Non-Converting", "AvgEvents").alias("other_events"),
        of("Converting", "AvgCarts").alias("converting_carts"),
        of("Non-Converting", "AvgCarts").alias("other_carts"),
    )


def category_bar_color(fact_category_performance: DataFrame, dim_category: DataFrame) -> DataFrame:
    """Colour per category; mislabeled ones stand out."""
    flagged = F.col("TaxonomyMislabeledFlag") == "Y"
    return fact_category_performance.join(dim_category, "CategoryCode", "left").select(
        "CategoryCode", F.when(flagged, vocab.AMBER).otherwise(vocab.BAR_BLUE).alias("bar_color")
    )


def insights(kpis: DataFrame, mart: dict[str, DataFrame]) -> DataFrame:
    """One computed sentence per report page: (page, insight)."""

    def page(name: str, table: DataFrame, text: str, *columns: str | Column) -> DataFrame:
        return table.select(F.lit(name).alias("page"), F.format_string(text, *columns).alias("insight"))

    pct = C.pct_text
    position = retention_position(mart["FactRetentionCurve"])
    category_name = F.when(F.col("is_mislabeled"), F.concat("display_name", F.lit(" (label unreliable)"))).otherwise(
        F.col("display_name")
    )
    covid = mart["FactCovidComparison"].where(
        F.col("Metric").isin("Avg Events / Session", "Avg Products Viewed", "Avg Order Value ($)")
    )

    def change_of(metric: str) -> Column:
        return F.max(F.when(F.col("Metric") == metric, F.col("ChangeText")))

    changes = covid.agg(
        change_of("Avg Events / Session").alias("events"),
        change_of("Avg Products Viewed").alias("products"),
        change_of("Avg Order Value ($)").alias("order_value"),
    )
    parts = [
        page(
            "Overview", kpis, "%s of sessions with a view convert; %s of carts are abandoned.",
            pct(F.col("overall_conversion_rate")), pct(F.col("cart_abandonment_rate")),
        ),
        page(
            "Retention", position, "Month-1 retention: %s.",
            F.concat(F.lower(F.substring("retention_position_text", 1, 1)),
                     F.expr("substring(retention_position_text, 2)")),
        ),
        page(
            "Opportunity", cart_abandonment_opportunity(kpis), "Abandoned carts could be worth up to $%.2f.",
            "cart_abandonment_opportunity",
        ),
        page(
            "Funnel depth", depth_swing(mart["FactSessionDepth"]),
            "The most engaged sessions convert %.1f times as often as the least engaged.", "depth_swing",
        ),
        page(
            "Funnel category", top_converting_category(mart["FactFunnelByCategory"], mart["DimCategory"]),
            "%s converts best at %s.", category_name, pct(F.col("conversion_rate"), 2),
        ),
        page(
            "Category", top_category_share(mart["FactCategoryPerformance"], mart["DimCategory"]),
            "%s brings %s of the revenue of the categories shown.", category_name, pct(F.col("revenue_share")),
        ),
        page(
            "Brand", top_brand_share(mart["FactTopBrands"]),
            "%s brings %s of the revenue of the brands shown.", "top_brand", pct(F.col("revenue_share")),
        ),
        page(
            "Customer segments", top_segment(mart["FactRFMSegment"]),
            "%s customers are %s of buyers and %s of revenue, %.1f times their share.",
            "top_segment", pct(F.col("user_share")), pct(F.col("revenue_share")), "revenue_multiple",
        ),
        page(
            "Session behavior", converting_gap(mart["FactConvertingVsNon"]),
            "Converting sessions average %.1f events and %.1f carts, others %.1f and %.1f.",
            "converting_events", "converting_carts", "other_events", "other_carts",
        ),
        page(
            "Before and after", changes,
            "After onset events per session changed by %s, products viewed by %s, order value by %s.",
            "events", "products", "order_value",
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
