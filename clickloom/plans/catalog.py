"""Every operator bound to the star-schema test tables, with thresholds fit for their size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import periods
from clickloom.functions.periods import PeriodSpec
from clickloom.operators import anomaly, category, cohort, experiment, funnel, partials, propensity, rfm, sessions
from clickloom.plans import alerts, mart, measures
from clickloom.plans.mart import MartSpec
from clickloom.sources import events as tables
from clickloom.sources import fixture
from clickloom.sources.stable import scratch_path, stored_once, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The test events cover January 2024 and the orders 1995 to 2001.
SPEC = PeriodSpec(pre_end=date(2024, 1, 15), onset_start=date(2024, 1, 18), excluded=(date(2024, 1, 10),))
CATEGORY_SPEC = replace(
    periods.CATEGORY_PERIODS,
    pre_start=date(2024, 1, 3), pre_end=SPEC.pre_end, onset_start=SPEC.onset_start, excluded=SPEC.excluded,
)
EVENTS_REFERENCE = date(2024, 2, 1)
ORDERS_REFERENCE = date(2001, 9, 1)
BAND = (1.0, 400.0)
MART = MartSpec(
    reference_date=EVENTS_REFERENCE,
    experiment_periods=SPEC,
    category_periods=CATEGORY_SPEC,
    min_views=10,
    min_category_views=10,
    min_purchases=5,
    funnel_categories=5,
    funnel_brands=8,
    top_categories=5,
    top_brands=10,
    shifted_categories=3,
    bot_events=10,
)
ALERTS = alerts.AlertSpec(
    conversion_floor_pct=90.0, abandonment_ceiling_pct=30.0, outlier_baseline=100, bot_events=10,
    bot_baseline=100,
)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles an operator leaves at full precision."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


def _register(source: Callable, **operators: Callable[[DataFrame], DataFrame]) -> None:
    for name, operator in operators.items():
        QUERIES[name] = lambda spark, folder, s=source, op=operator: op(s(spark, folder))


# Funnels
_register(
    fixture.session_events,
    funnel_overall=funnel.funnel_overall,
    cart_abandonment=funnel.cart_abandonment,
    direct_checkout=funnel.direct_checkout,
    sessions_without_view=funnel.sessions_without_view,
)
_register(
    fixture.full_events,
    funnel_by_category=lambda ev: funnel.funnel_by_category(ev, 10),
    funnel_by_brand=lambda ev: funnel.funnel_by_brand(ev, 10),
)

# Sessions
_register(
    fixture.session_events,
    session_stats=sessions.session_stats,
    session_summary=lambda ev: sessions.session_summary(ev),
    session_depth_buckets=sessions.session_depth_buckets,
    session_profile=lambda ev: sessions.session_profile(ev),
)

_register(
    fixture.stored_session_events,
    purchase_ranks=sessions.purchase_ranks,
    depth_at_purchase=lambda ev: sessions.depth_at_purchase(ev),
)

# RFM
_register(
    fixture.base_events,
    rfm_raw=lambda ev: rounded(rfm.rfm_raw(ev, EVENTS_REFERENCE), 2),
    rfm_scores=lambda ev: rounded(rfm.rfm_scores(rfm.rfm_raw(ev, EVENTS_REFERENCE)), 2),
    rfm_segments=lambda ev: rfm.rfm_segments(ev, EVENTS_REFERENCE),
)
_register(
    fixture.order_events,
    rfm_segments_orders=lambda ev: rfm.rfm_segments(ev, ORDERS_REFERENCE),
    rfm_preview=lambda ev: rfm.rfm_preview(rfm.rfm_segments(ev, ORDERS_REFERENCE), 1000),
    rfm_distribution=lambda ev: rfm.rfm_distribution(rfm.rfm_segments(ev, ORDERS_REFERENCE)),
    rfm_monetary_percentiles=lambda ev: rfm.rfm_monetary_percentiles(
        rfm.rfm_segments(ev, ORDERS_REFERENCE)
    ),
)

# Cohorts
_register(
    fixture.order_events,
    cohort_retention=cohort.cohort_retention,
    cohort_matrix=cohort.cohort_matrix,
    cohort_matrix_nullable=cohort.cohort_matrix_nullable,
    retention_curve=cohort.retention_curve,
)

# Categories and brands
_register(
    fixture.product_events,
    category_performance=lambda ev: category.category_performance(ev, 10),
    category_performance_priced=lambda ev: category.category_performance_priced(ev, 10),
    brand_ranking=lambda ev: category.brand_ranking(ev, 5),
    top_brands_in_top_categories=category.top_brands_in_top_categories,
)
_register(
    fixture.lineitem_events,
    monthly_category_trend=lambda ev: category.monthly_category_trend(ev, 4),
    top_brands_lineitem=category.top_brands_in_top_categories,
)

# Anomalies
_register(
    fixture.product_events,
    price_outlier_summary=lambda ev: anomaly.price_outlier_summary(ev),
    weekly_category_shift=anomaly.weekly_category_shift,
)
_register(
    fixture.lineitem_events,
    price_outlier_summary_lineitem=lambda ev: anomaly.price_outlier_summary(ev),
)
_register(
    fixture.stored_events,
    price_outliers=lambda ev: anomaly.price_outliers(ev),
)
_register(
    fixture.session_events,
    high_frequency_sessions=lambda ev: anomaly.high_frequency_sessions(ev, 10),
    repeat_cap_purchases=lambda ev: anomaly.repeat_cap_purchases(ev, *BAND),
)
_register(
    fixture.base_events,
    daily_volume_zscore=anomaly.daily_volume_zscore,
    cap_concentration=lambda ev: anomaly.cap_concentration(ev, *BAND),
    lowest_volume_days=anomaly.lowest_volume_days,
)
_register(fixture.order_events, daily_volume_zscore_orders=anomaly.daily_volume_zscore)

# Experiment
_register(
    fixture.base_events,
    assign_period=lambda ev: experiment.assign_period(ev, SPEC, with_transition=True)
    .groupBy("period").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event")),
    new_vs_returning=lambda ev: experiment.new_vs_returning(ev, SPEC),
    buyer_mix_daily=lambda ev: experiment.buyer_mix_daily(
        experiment.new_vs_returning(ev, SPEC), SPEC, *experiment.period_days(ev, SPEC)
    ),
)
_register(
    fixture.session_events,
    period_funnel=lambda ev: experiment.period_funnel(ev, SPEC),
    weekly_trend=lambda ev: experiment.weekly_trend(ev, SPEC),
    period_session_behavior=lambda ev: experiment.period_session_behavior(ev, SPEC),
    ztest_larger=lambda ev: rounded(experiment.two_proportion_ztest(experiment.period_funnel(ev, SPEC), SPEC)),
    ztest_smaller=lambda ev: rounded(
        experiment.two_proportion_ztest(experiment.period_funnel(ev, SPEC), SPEC, "smaller")
    ),
    ztest_two_sided=lambda ev: rounded(
        experiment.two_proportion_ztest(experiment.period_funnel(ev, SPEC), SPEC, "two-sided")
    ),
    proportion_effect=lambda ev: rounded(experiment.proportion_effect(experiment.period_funnel(ev, SPEC), SPEC)),
    weekly_conversion_merged=lambda ev: experiment.weekly_conversion_merged(experiment.weekly_trend(ev, SPEC)),
    pct_change_from_baseline=lambda ev: experiment.pct_change_from_baseline(
        experiment.period_session_behavior(ev, SPEC),
        ["avg_events_per_session", "avg_products_viewed", "session_purchase_rate_pct", "avg_session_revenue"],
        SPEC,
    ),
    period_session_conversion=lambda ev: experiment.period_session_conversion(ev, date(2024, 1, 16)),
)
_register(
    fixture.product_events,
    category_mix_shift=lambda ev: experiment.category_mix_shift(ev, CATEGORY_SPEC),
    category_share_delta=lambda ev: experiment.category_share_delta(
        experiment.category_mix_shift(ev, CATEGORY_SPEC), CATEGORY_SPEC
    ),
)


# Propensity
def _features(spark: SparkSession, folder: str) -> DataFrame:
    """The stored features table that all propensity queries read."""
    return stored_once(
        spark, fixture.event_files(folder), "propensity-features",
        lambda: propensity.propensity_features(fixture.stored_events(spark, folder), 3, SPEC),
    )


def _fixed_scores(features: DataFrame) -> DataFrame:
    """Scores by a fixed formula, so that the reports on scores can be checked against SQL."""
    logit = (
        F.lit(-0.4)
        + 0.25 * F.col("cart_in_cutoff")
        + 0.1 * F.col("products_viewed")
        + 0.002 * F.col("avg_price_viewed")
        + 0.05 * F.col("prior_purchase_count")
        - 0.03 * F.coalesce(F.col("days_since_last_purchase"), F.lit(0))
    )
    return (
        features
        .where(propensity.HOLDOUT)
        .select(
            "user_session",
            F.col(propensity.LABEL).cast("int").alias(propensity.LABEL),
            F.round(1 / (1 + F.exp(-logit)), 6).alias("purchase_prob"),
        )
    )


def _model_scores(features: DataFrame) -> DataFrame:
    """To six digits, which the Newton steps have settled."""
    model = propensity.fit_propensity(features)
    scored = propensity.score_sessions(model, features.where(propensity.HOLDOUT), propensity.newton(model, features))
    return rounded(scored)


def _coefficients(features: DataFrame) -> DataFrame:
    fit = propensity.newton(propensity.fit_propensity(features), features)
    return rounded(propensity.coefficients(fit, features)).withColumn("newton_step", F.lit(round(fit.step, 6)))


_register(
    _features,
    propensity_features=lambda features: features,
    propensity_evaluation=lambda features: propensity.evaluate_propensity(_fixed_scores(features)),
    propensity_roc_curve=lambda features: propensity.roc_curve(_fixed_scores(features)),
    propensity_decile_lift=lambda features: propensity.decile_lift(_fixed_scores(features)),
    propensity_calibration=lambda features: propensity.calibration(_fixed_scores(features)),
    propensity_model_evaluation=lambda features: propensity.evaluate_propensity(_model_scores(features)),
    propensity_model_scores=_model_scores,
    propensity_model_coefficients=_coefficients,
    propensity_model_residuals=lambda f: propensity.fit_residuals(propensity.fit_propensity(f), f),
)


# Sources and sinks
@query
def events_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Write all events as CSV, read them back with the fixed schema, and count by day and type."""
    path = scratch_path(spark, "events-csv")
    tables.write_events_csv(fixture.full_events(spark, folder), path)
    ev = tables.read_events_csv(spark, path)
    return ev.groupBy(F.to_date("event_time").alias("event_date"), "event_type").agg(
        F.count("*").alias("events"), C.total(F.col("price"), 2).alias("price_sum"),
        F.count("brand").alias("branded"), F.count("category_code").alias("categorised"),
    )


@query
def result_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Write a query result as CSV with a header and read it back."""
    path = scratch_path(spark, "result-csv")
    result = anomaly.daily_volume_zscore(fixture.base_events(spark, folder))
    tables.write_csv(result, path)
    return spark.read.schema(result.schema).option("header", True).csv(path)


@query
def events_pruned_read(spark: SparkSession, folder: str) -> DataFrame:
    """Write the day-partitioned table in two loads, the second one twice, and read the purchases of a date range."""
    path = scratch_path(spark, "events-table")
    ev = fixture.product_events(spark, folder)
    day = F.to_date("event_time")
    tables.write_events(ev.where(day < F.lit(date(2024, 1, 16))), path)
    for _ in range(2):
        tables.append_events(ev.where(day >= F.lit(date(2024, 1, 16))), path, "second half")
    bought = tables.read_events(spark, path, date(2024, 1, 8), date(2024, 1, 21), "purchase")
    return bought.select("event_id", "event_date", "event_type", "user_id", "price")


@query
def saved_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Store the segments table, replace it, and summarise it."""
    path = scratch_path(spark, "rfm-segments")
    segments = tables.save_table(rfm.rfm_segments(fixture.base_events(spark, folder), EVENTS_REFERENCE), path)
    return rfm.rfm_distribution(segments)


_register(
    fixture.order_events,
    events_per_month=tables.events_per_month,
)
_register(fixture.typed_events, event_type_distribution=tables.event_type_distribution)


# Mart
def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return mart.segments_table(fixture.base_events(spark, folder), MART)


def _retention(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohort_retention(fixture.order_events(spark, folder))


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    return mart.fact_retention_curve(cohort.retention_curve(fixture.order_events(spark, folder)), MART)


def _rfm_segment(spark: SparkSession, folder: str) -> DataFrame:
    return mart.fact_rfm_segment(_segments(spark, folder))


def _visits(spark: SparkSession, folder: str) -> DataFrame:
    """The stored partial aggregate that mart, insights and alerts are finished from."""
    return stored_once(
        spark, fixture.event_files(folder), "visits", lambda: partials.visits(fixture.stored_events(spark, folder)))


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    ev = fixture.stored_events(spark, folder)
    return mart.fact_anomaly_findings(_visits(spark, folder), mart.fact_price_outliers(ev, MART), MART)


_register(_segments, mart_rfm_segment=mart.fact_rfm_segment,
          mart_rfm_monetary_dist=lambda s: mart.fact_rfm_monetary_dist(s, MART))
_register(_rfm_segment, mart_dim_segment=mart.dim_segment)
_register(
    _retention,
    mart_dim_cohort_month=mart.dim_cohort_month,
    mart_cohort_retention=lambda r: mart.fact_cohort_retention(r, MART),
)
_register(
    fixture.order_events,
    mart_retention_curve=lambda ev: mart.fact_retention_curve(cohort.retention_curve(ev), MART),
    mart_dim_months_since_first=lambda ev: mart.dim_months_since_first(cohort.retention_curve(ev), MART),
)
_register(
    fixture.product_events,
    mart_dim_category=mart.dim_category,
    mart_category_performance=lambda ev: mart.fact_category_performance(ev, MART),
    mart_top_brands=lambda ev: mart.fact_top_brands(ev, MART),
    mart_price_outliers=lambda ev: mart.fact_price_outliers(ev, MART),
    mart_category_mix_shift=lambda ev: mart.fact_category_mix_shift(ev, MART),
)
_register(
    fixture.full_events,
    mart_funnel_by_category=lambda ev: mart.fact_funnel_by_category(ev, MART),
    mart_funnel_by_brand=lambda ev: mart.fact_funnel_by_brand(ev, MART),
    mart_dim_brand=lambda ev: mart.dim_brand(
        mart.fact_top_brands(ev, MART), mart.fact_funnel_by_brand(ev, MART)
    ),
)
_register(
    fixture.session_events,
    mart_session_depth=mart.fact_session_depth,
    mart_converting_vs_non=lambda ev: mart.fact_converting_vs_non(ev, MART),
    mart_covid_comparison=lambda ev: mart.fact_covid_comparison(ev, MART),
)
QUERIES["mart_anomaly_findings"] = _findings


@query
def mart_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Build and store the whole mart, and count the rows of each stored table."""
    path = scratch_path(spark, "mart")
    ev = fixture.stored_events(spark, folder)
    stored = mart.build_mart(ev, path, MART, fixture.order_events(spark, folder), _visits(spark, folder))
    out = None
    for name, table in stored.items():
        row = table.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        out = row if out is None else out.union(row)
    return out


# Measures
_register(
    lambda spark, folder: mart.fact_category_performance(fixture.product_events(spark, folder), MART),
    measure_weighted_avg_price=measures.weighted_avg_price,
    measure_weighted_avg_price_by_category=lambda t: measures.weighted_avg_price(t, ["CategoryCode"]),
    measure_purchase_volume_median=measures.category_purchase_volume_median,
)
_register(
    lambda spark, folder: mart.fact_top_brands(fixture.product_events(spark, folder), MART),
    measure_brand_weighted_avg_price=measures.brand_weighted_avg_price,
    measure_top_brand_share=measures.top_brand_share,
)
_register(
    lambda spark, folder: mart.fact_funnel_by_category(fixture.full_events(spark, folder), MART),
    measure_category_conversion_rate=measures.category_conversion_rate,
)
_register(
    lambda spark, folder: mart.fact_funnel_by_brand(fixture.full_events(spark, folder), MART),
    measure_brand_conversion_rate=measures.brand_conversion_rate,
)
_register(
    lambda spark, folder: mart.fact_session_depth(fixture.session_events(spark, folder)),
    measure_session_conversion_rate=measures.session_conversion_rate,
    measure_depth_swing=measures.depth_swing,
)
_register(
    _retention,
    measure_weighted_avg_retention=lambda r: measures.weighted_avg_retention(
        mart.fact_cohort_retention(r, MART), mart.dim_cohort_month(r)
    ),
    measure_weighted_avg_retention_by_month=lambda r: measures.weighted_avg_retention(
        mart.fact_cohort_retention(r, MART), mart.dim_cohort_month(r), ["MonthsSinceFirst"]
    ),
)
_register(
    lambda spark, folder: mart.fact_price_outliers(fixture.product_events(spark, folder), MART),
    measure_weighted_outlier_rate=measures.weighted_outlier_rate,
)
_register(
    _rfm_segment,
    measure_weighted_avg_monetary=measures.weighted_avg_monetary,
    measure_champion_share=measures.champion_share,
    measure_top_segment=measures.top_segment,
)
_register(
    lambda spark, folder: mart.fact_converting_vs_non(fixture.session_events(spark, folder), MART),
    measure_sessions_grand_total=measures.sessions_grand_total,
    measure_median_session_duration=measures.median_session_duration,
    measure_converting_gap=measures.converting_gap,
)
_register(
    lambda spark, folder: mart.fact_covid_comparison(fixture.session_events(spark, folder), MART),
    measure_covid_formatted=measures.covid_formatted,
    measure_conversion_lift=measures.conversion_lift,
)
_register(
    _curve,
    measure_month1_retention=measures.month1_retention,
    measure_retention_position=measures.retention_position,
)
_register(
    lambda spark, folder: measures.overview_kpis(fixture.session_events(spark, folder)),
    measure_overview_kpis=lambda kpis: kpis,
    measure_per_buyer=measures.per_buyer,
    measure_cart_abandonment_opportunity=measures.cart_abandonment_opportunity,
)


@query
def measure_champion_revenue(spark: SparkSession, folder: str) -> DataFrame:
    segments = _segments(spark, folder)
    return measures.champion_revenue(mart.fact_rfm_segment(segments), segments)


@query
def measure_top_converting_category(spark: SparkSession, folder: str) -> DataFrame:
    ev = fixture.full_events(spark, folder)
    return measures.top_converting_category(
        mart.fact_funnel_by_category(ev, MART), mart.dim_category(fixture.product_events(spark, folder))
    )


@query
def measure_top_category_share(spark: SparkSession, folder: str) -> DataFrame:
    ev = fixture.product_events(spark, folder)
    return measures.top_category_share(mart.fact_category_performance(ev, MART), mart.dim_category(ev))


@query
def measure_category_bar_color(spark: SparkSession, folder: str) -> DataFrame:
    ev = fixture.product_events(spark, folder)
    return measures.category_bar_color(mart.fact_category_performance(ev, MART), mart.dim_category(ev))


@query
def measure_insights(spark: SparkSession, folder: str) -> DataFrame:
    ev, visits = fixture.stored_events(spark, folder), _visits(spark, folder)
    by_session = written(partials.session_partials(visits), "session-partials")
    return measures.insights(
        measures.overview_kpis(visits),
        {
            "DimCategory": mart.dim_category(visits),
            "FactRetentionCurve": _curve(spark, folder),
            "FactSessionDepth": mart.fact_session_depth(by_session),
            "FactFunnelByCategory": mart.fact_funnel_by_category(visits, MART),
            "FactCategoryPerformance": mart.fact_category_performance(visits, MART),
            "FactTopBrands": mart.fact_top_brands(visits, MART),
            "FactRFMSegment": mart.fact_rfm_segment(mart.segments_table(visits, MART)),
            "FactConvertingVsNon": mart.fact_converting_vs_non(by_session, MART),
            "FactCovidComparison": mart.fact_covid_comparison(ev, MART, visits),
        },
    )


@query
def kpi_alerts(spark: SparkSession, folder: str) -> DataFrame:
    ev = fixture.stored_events(spark, folder)
    return rounded(alerts.kpi_alerts(ev, ALERTS, fixture.order_events(spark, folder), _visits(spark, folder)))


_register(
    fixture.product_events,
    weekly_top_category_conversion=alerts.weekly_top_category_conversion,
)
_register(fixture.base_events, daily_revenue_zscore=alerts.daily_revenue_zscore)
