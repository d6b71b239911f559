"""Star-schema mart of the results: small dimension and fact tables for reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import periods, vocab
from clickloom.functions.periods import PeriodSpec
from clickloom.operators import anomaly, category, cohort, experiment, funnel, partials, rfm, sessions
from clickloom.sources.stable import written

@dataclass(frozen=True)
class MartSpec:
    """Sizes and thresholds of the mart tables."""

    # The published sizes and thresholds.
    reference_date: date = rfm.REFERENCE_DATE
    experiment_periods: PeriodSpec = PeriodSpec()
    category_periods: PeriodSpec = periods.CATEGORY_PERIODS
    min_views: int = 1000
    min_category_views: int = 10_000
    min_purchases: int = 100
    funnel_categories: int = 10
    funnel_brands: int = 8
    top_categories: int = 8
    top_brands: int = 10
    shifted_categories: int = 6
    bot_events: int = 500
    months: int | None = None  # offsets shown; all observed ones by default


MISLABELED = [code for code, _, flag in vocab.CATEGORY_DIMENSION if flag]
_DIMENSION_NAMES = {code: name for code, name, _ in vocab.CATEGORY_DIMENSION}


def _fraction(column: str, digits: int):
    return F.round(F.col(column) / 100, digits)


def _month_label(year_month):
    """'2019-10' -> 'Oct 2019'."""
    return F.date_format(F.to_date(F.concat(year_month, F.lit("-01"))), "MMM yyyy")


def _offset_label(offset):
    return F.concat(F.lit("M"), offset.cast("string"))


def dim_category(ev: DataFrame) -> DataFrame:
    code = F.col("CategoryCode")
    return (
        ev.select(C.category(ev).alias("CategoryCode"))
        .distinct()
        .select(
            "CategoryCode",
            vocab.display_name(code, _DIMENSION_NAMES).alias("DisplayName"),
            F.when(code.isin(MISLABELED), "Y").otherwise("").alias("TaxonomyMislabeledFlag"),
        )
    )


def dim_segment(fact_rfm_segment: DataFrame) -> DataFrame:
    order = {name: str(i + 1) for i, name in enumerate(vocab.SEGMENTS)}
    return fact_rfm_segment.select(
        "Segment", vocab.display_name(F.col("Segment"), order).cast("int").alias("SortOrder")
    )


def dim_brand(fact_top_brands: DataFrame, fact_funnel_by_brand: DataFrame) -> DataFrame:
    return fact_top_brands.select("Brand").union(fact_funnel_by_brand.select("Brand")).distinct()


def _shown(table: DataFrame, spec: MartSpec) -> DataFrame:
    return table if spec.months is None else table.where(F.col("months_since_first") <= spec.months)


def dim_months_since_first(curve: DataFrame, spec: MartSpec) -> DataFrame:
    offset = F.col("months_since_first")
    return _shown(curve, spec).select(_offset_label(offset).alias("MonthsSinceFirst"), offset.alias("SortOrder"))


def dim_cohort_month(retention: DataFrame) -> DataFrame:
    """One row per cohort, numbered; the window runs over those rows."""
    first = retention.where(F.col("months_since_first") == 0)
    return first.select(
        _month_label(F.col("cohort_month")).alias("CohortMonth"),
        F.row_number().over(W.orderBy("cohort_month")).alias("SortOrder"),
        F.col("cohort_users").alias("CohortUsers"),
    )


def fact_funnel_by_category(ev: DataFrame, spec: MartSpec) -> DataFrame:
    return funnel.funnel_by_category(ev, spec.min_views, spec.funnel_categories).select(
        F.col("top_category").alias("CategoryCode"),
        F.col("views").alias("Views"),
        F.col("carts").alias("Carts"),
        F.col("purchases").alias("Purchases"),
        _fraction("overall_conversion_pct", 4).alias("ConversionPct"),
    )


def fact_funnel_by_brand(ev: DataFrame, spec: MartSpec) -> DataFrame:
    return funnel.funnel_by_brand(ev, spec.min_views, spec.funnel_brands).select(
        F.col("brand").alias("Brand"),
        F.col("views").alias("Views"),
        F.col("purchases").alias("Purchases"),
        _fraction("overall_conversion_pct", 4).alias("OverallConvPct"),
        _fraction("cart_to_purchase_pct", 4).alias("CartToPurchasePct"),
    )


def fact_session_depth(ev: DataFrame) -> DataFrame:
    return sessions.session_depth_buckets(ev).select(
        F.substring_index("event_bucket", ": ", -1).alias("EventBucket"),
        F.col("total_sessions").alias("TotalSessions"),
        F.col("purchasing_sessions").alias("PurchasingSessions"),
        _fraction("conversion_rate_pct", 4).alias("ConversionPct"),
    )


def fact_converting_vs_non(ev: DataFrame, spec: MartSpec) -> DataFrame:
    return sessions.session_profile(ev).select(
        F.col("session_type").alias("SessionType"),
        F.col("session_count").alias("Sessions"),
        F.col("avg_total_events").alias("AvgEvents"),
        F.col("median_total_events").alias("MedianEvents"),
        F.col("avg_carts").alias("AvgCarts"),
        F.col("median_duration_minutes").alias("MedianDurationMin"),
    )


def fact_rfm_segment(segments: DataFrame) -> DataFrame:
    return rfm.rfm_distribution(segments).select(
        F.col("segment").alias("Segment"),
        _fraction("pct_of_users", 4).alias("PctUsers"),
        _fraction("pct_of_revenue", 4).alias("PctRevenue"),
        F.col("avg_recency_days").alias("AvgRecencyDays"),
        F.col("avg_frequency").alias("AvgFrequency"),
        F.col("avg_monetary").alias("AvgMonetary"),
    )


def fact_rfm_monetary_dist(segments: DataFrame, spec: MartSpec) -> DataFrame:
    return rfm.rfm_monetary_percentiles(segments).select(
        F.col("segment").alias("Segment"),
        F.col("p25_monetary").alias("P25"),
        F.col("median_monetary").alias("Median"),
        F.col("p75_monetary").alias("P75"),
        F.col("p90_monetary").alias("P90"),
        F.col("max_monetary").alias("Max"),
    )


def fact_cohort_retention(retention: DataFrame, spec: MartSpec) -> DataFrame:
    """Observed cells only; unobserved ones have no row."""
    return _shown(retention, spec).select(
        _month_label(F.col("cohort_month")).alias("CohortMonth"),
        _offset_label(F.col("months_since_first")).alias("MonthsSinceFirst"),
        F.round(C.ratio(F.col("active_users"), F.col("cohort_users")), 3).alias("RetentionRate"),
    )


def fact_retention_curve(curve: DataFrame, spec: MartSpec) -> DataFrame:
    return _shown(curve, spec).select(
        _offset_label(F.col("months_since_first")).alias("MonthsSinceFirst"),
        _fraction("avg_retention_pct", 4).alias("AvgRetention"),
        _fraction("min_retention_pct", 4).alias("MinRetention"),
        _fraction("max_retention_pct", 4).alias("MaxRetention"),
    )


def fact_category_performance(ev: DataFrame, spec: MartSpec) -> DataFrame:
    counts = category.category_counts(ev).where(F.col("total_views") > spec.min_category_views)
    return (
        counts.orderBy(F.desc("total_revenue"), "raw_category")
        .limit(spec.top_categories)
        .select(
            F.col("raw_category").alias("CategoryCode"),
            F.col("total_views").alias("Views"),
            F.col("total_purchases").alias("Purchases"),
            F.col("total_revenue").alias("TotalRevenue"),
            F.col("avg_purchase_price").alias("AvgPrice"),
        )
    )


def fact_top_brands(ev: DataFrame, spec: MartSpec) -> DataFrame:
    return category.brand_ranking(ev, spec.min_purchases, spec.top_brands).select(
        F.col("brand").alias("Brand"),
        F.col("total_purchases").alias("Purchases"),
        F.col("total_revenue").alias("TotalRevenue"),
        F.col("avg_purchase_price").alias("AvgPrice"),
        F.col("category_count").alias("CategoriesCount"),
    )


def fact_price_outliers(ev: DataFrame, spec: MartSpec) -> DataFrame:
    return anomaly.price_outlier_summary(ev).select(
        F.col("top_category").alias("CategoryCode"),
        F.col("total_purchases").alias("TotalPurchases"),
        F.col("q1").alias("Q1"),
        F.col("q3").alias("Q3"),
        F.col("iqr").alias("IQR"),
        F.col("upper_fence").alias("UpperFence"),
        F.col("max_price").alias("MaxPrice"),
        F.col("outlier_count").alias("OutlierCount"),
        _fraction("outlier_pct", 5).alias("OutlierPct"),
        F.col("max_to_fence_ratio").alias("MaxToFenceRatio"),
    )


def fact_anomaly_findings(ev: DataFrame, price_outliers: DataFrame, spec: MartSpec) -> DataFrame:
    """One computed sentence per kind of anomaly. ``ev``: events or ``visits``."""
    top = F.max("MaxPrice").over(W.partitionBy())  # one row per category
    cap = (
        price_outliers.withColumn("_cap", top)
        .agg(
            F.count_if(F.col("MaxPrice") == F.col("_cap")).alias("at_cap"),
            F.count("*").alias("n"),
            F.max("_cap").alias("cap"),
        )
        .select(
            F.lit("Price cap").alias("Finding"),
            F.format_string("%d of %d categories reach the highest price %.2f.", "at_cap", "n", "cap").alias("Detail"),
        )
    )
    bots = (
        anomaly.busy_sessions(ev, spec.bot_events)
        .agg(F.count("*").alias("n"), F.count_if(F.col("purchases") == 0).alias("idle"))
        .select(
            F.lit("Bot detection").alias("Finding"),
            F.format_string(
                f"%d sessions with more than {spec.bot_events} events, %d of them without a purchase.", "n", "idle"
            ).alias("Detail"),
        )
    )
    gap = (
        anomaly.daily_volume_zscore(ev)
        .where(F.col("z_score").isNotNull())
        .orderBy("z_score", "event_date")
        .limit(1)
        .select(
            F.lit("Logging gap").alias("Finding"),
            F.format_string(
                "%s: %d events against a mean of %.0f (z = %.2f).",
                F.col("event_date").cast("string"), "daily_events", "rolling_7d_avg", "z_score",
            ).alias("Detail"),
        )
    )
    names = {code: code for code in MISLABELED}
    weekly = anomaly.weekly_category_shift(ev, names)
    before = F.lag("weekly_revenue").over(W.partitionBy("category").orderBy("week_start"))  # one row per week
    shift = (
        weekly.withColumn("_before", before)
        .where(F.col("_before").isNotNull())
        .orderBy(F.desc(F.col("weekly_revenue") - F.col("_before")), "week_start", "category")
        .limit(1)
        .select(
            F.lit("Taxonomy shift").alias("Finding"),
            F.format_string(
                "%s revenue went from %.2f to %.2f in the week of %s.",
                "category", "_before", "weekly_revenue", F.col("week_start").cast("string"),
            ).alias("Detail"),
        )
    )
    return cap.union(bots).union(gap).union(shift)


def fact_covid_comparison(ev: DataFrame, spec: MartSpec, visits: DataFrame | None = None) -> DataFrame:
    """Five metrics of the two periods side by side. The funnel can be read from ``visits``, products only from events."""
    periods_ = spec.experiment_periods
    joined = experiment.period_funnel(ev if visits is None else visits, periods_).select(
        "period", "session_conversion_pct", "avg_order_value"
    ).join(
        experiment.period_session_behavior(ev, periods_).select(
            "period", "avg_events_per_session", "avg_products_viewed", "avg_session_revenue"
        ),
        "period",
    )
    # Metric names of the report.
    names = {
        "session_conversion_pct": "Session Conversion %",
        "avg_order_value": "Avg Order Value ($)",
        "avg_events_per_session": "Avg Events / Session",
        "avg_products_viewed": "Avg Products Viewed",
        "avg_session_revenue": "Avg Session Revenue ($)",
    }
    change = experiment.pct_change_from_baseline(joined, list(names), periods_)
    is_rate = F.col("metric") == "session_conversion_pct"

    def shown(column: str):
        return F.when(is_rate, F.round(F.col(column) / 100, 4)).otherwise(F.col(column))

    return change.select(
        vocab.display_name(F.col("metric"), names).alias("Metric"),
        shown("pre_value").alias("PreCovid"),
        shown("onset_value").alias("CovidOnset"),
        C.signed_pct_text(F.col("pct_change") / 100).alias("ChangeText"),
    )


def fact_category_mix_shift(ev: DataFrame, spec: MartSpec) -> DataFrame:
    """Categories whose share of revenue moved most, without the mislabeled ones."""
    p = spec.category_periods
    mix = experiment.category_mix(ev, p).where(~F.col("raw_category").isin(MISLABELED))
    shares = mix.groupBy("raw_category").agg(
        F.max(F.when(F.col("period") == p.pre_label, F.col("revenue_share_pct"))).alias("pre"),
        F.max(F.when(F.col("period") == p.onset_label, F.col("revenue_share_pct"))).alias("onset"),
    )
    return (
        shares.withColumn("delta", F.round(F.col("onset") - F.col("pre"), 2))
        .orderBy(F.desc(F.abs("delta")), "raw_category")
        .limit(spec.shifted_categories)
        .select(
            F.col("raw_category").alias("CategoryCode"),
            _fraction("pre", 4).alias("PreCovidSharePct"),
            _fraction("onset", 4).alias("CovidSharePct"),
            F.round("delta", 1).alias("DeltaPP"),
        )
    )


def segments_table(purchases: DataFrame, spec: MartSpec) -> DataFrame:
    return rfm.rfm_segments(purchases, spec.reference_date)


def mart_tables(
    ev: DataFrame, spec: MartSpec = MartSpec(), history: DataFrame | None = None, visits: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All 19 tables. ``history`` may hold a longer purchase record for the cohort tables.

    ``visits``: the partial aggregate of the events (``partials.visits``), if it is there already; else it is made and
    written. Events themselves are read for it, for single prices, for products viewed per period and, without
    ``history``, for cohorts. Runs Spark jobs when called.
    """
    visits = written(partials.visits(ev), "visits") if visits is None else visits
    by_session = written(partials.session_partials(visits), "session-partials")
    segments = written(segments_table(visits, spec), "segments")
    retention = written(cohort.cohort_retention(ev if history is None else history), "retention")
    curve = cohort.curve_of(retention)
    rfm_segment = fact_rfm_segment(segments)
    top_brands = written(fact_top_brands(visits, spec), "top-brands")
    brand_funnel = written(fact_funnel_by_brand(visits, spec), "brand-funnel")
    outliers = written(fact_price_outliers(ev, spec), "price-outliers")
    return {
        "DimCategory": dim_category(visits),
        "DimSegment": dim_segment(rfm_segment),
        "DimBrand": dim_brand(top_brands, brand_funnel),
        "DimMonthsSinceFirst": dim_months_since_first(curve, spec),
        "DimCohortMonth": dim_cohort_month(retention),
        "FactFunnelByCategory": fact_funnel_by_category(visits, spec),
        "FactFunnelByBrand": brand_funnel,
        "FactSessionDepth": fact_session_depth(by_session),
        "FactConvertingVsNon": fact_converting_vs_non(by_session, spec),
        "FactRFMSegment": rfm_segment,
        "FactRFMMonetaryDist": fact_rfm_monetary_dist(segments, spec),
        "FactCohortRetention": fact_cohort_retention(retention, spec),
        "FactRetentionCurve": fact_retention_curve(curve, spec),
        "FactCategoryPerformance": fact_category_performance(visits, spec),
        "FactTopBrands": top_brands,
        "FactPriceOutliers": outliers,
        "FactAnomalyFindings": fact_anomaly_findings(visits, outliers, spec),
        "FactCovidComparison": fact_covid_comparison(ev, spec, visits),
        "FactCategoryMixShift": fact_category_mix_shift(visits, spec),
    }


# So many tables are written at once: most are a few rows, and jobs of one task leave the other cores idle.
WRITERS = 6


def build_mart(
    ev: DataFrame, folder: str, spec: MartSpec = MartSpec(), history: DataFrame | None = None, visits: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Write every mart table as parquet below ``folder`` and return the stored tables."""
    spark = ev.sparkSession

    def store(table: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
        name, df = table
        df.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/{name}")  # small tables: one file each
        return name, spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    with ThreadPoolExecutor(WRITERS) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(store), mart_tables(ev, spec, history, visits).items()))


def read_mart(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
