"""Seven watch rules over the headline numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab
from clickloom.operators import anomaly, cohort, funnel, partials
from clickloom.sources.stable import written


@dataclass(frozen=True)
class AlertSpec:
    """Limits of the rules; baselines come from the owner's own history."""

    conversion_floor_pct: float = 5.0
    abandonment_ceiling_pct: float = 60.0
    revenue_sigmas: float = 2.0
    weekly_drop_pct: float = 20.0
    outlier_baseline: int = 500_000
    bot_events: int = 500
    bot_baseline: int = 400


def daily_revenue_zscore(ev: DataFrame, days: int = 7, sigmas: float = 2.0) -> DataFrame:
    """Daily revenue against the days before it; mean and deviation, shown in cents, are not rounded for the score."""
    daily = ev.where(C.holds_priced(ev)).groupBy(C.day(ev).alias("event_date"))
    scored = anomaly.daily_zscore(
        daily.agg(C.amount(C.revenue(ev)).alias("revenue")), "revenue", days, sigmas, digits=None
    )
    return scored.withColumns({c: F.round(c, 2) for c in (f"rolling_{days}d_avg", f"rolling_{days}d_stddev")})


def weekly_top_category_conversion(ev: DataFrame) -> DataFrame:
    """Purchases per view and week of the category with the highest revenue, with the change to the week before."""
    return _weekly_conversion(ev).drop("_complete")


def _weekly_conversion(ev: DataFrame) -> DataFrame:
    """With ``_complete``: the events reach the last day of the week."""
    weekly = ev.groupBy(C.category(ev).alias("top_category"), C.week(ev).alias("week_start")).agg(
        C.n_type(ev, vocab.VIEW).alias("views"),
        C.n_type(ev, vocab.PURCHASE).alias("purchases"),
        C.revenue(ev).alias("revenue"),
        F.max(C.day(ev)).alias("_last"),
    )
    last_day = F.max("_last").over(W.partitionBy())  # one row per category and week
    weekly = weekly.withColumn("_complete", F.date_add("week_start", 6) <= last_day)
    leader = (
        weekly.groupBy("top_category")
        .agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("total"))
        .orderBy(F.desc("total"), "top_category")
        .limit(1)
        .select("top_category")
    )
    rates = weekly.join(F.broadcast(leader), "top_category", "left_semi").withColumn(  # one row
        "conversion_pct", C.pct(F.col("purchases"), F.col("views"), 4)
    )
    before = F.lag("conversion_pct").over(W.partitionBy("top_category").orderBy("week_start"))  # one row per week
    return rates.select(
        "top_category",
        "week_start",
        "conversion_pct",
        C.pct(F.col("conversion_pct") - before, before, 4).alias("change_pct"),
        "_complete",
    )


def _rule(table: DataFrame, name: str, value: str | Column, limit: Column, fires: Column) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return table.select(
        F.lit(name).alias("kpi"),
        value.cast("double").alias("value"),
        limit.cast("double").alias("limit_value"),
        F.coalesce(fires, F.lit(False)).alias("alert"),
    )


def _latest(table: DataFrame, order: str) -> DataFrame:
    return table.orderBy(F.desc(order)).limit(1)


def latest_month1_retention(ev: DataFrame) -> DataFrame:
    """Month-1 retention of the latest cohort that has one, and the lower quartile of the cohorts before it."""
    first_month = cohort.cohort_retention(ev).where(F.col("months_since_first") == 1)
    latest = F.max("cohort_month").over(W.partitionBy())  # one row per cohort
    marked = first_month.withColumn("_is_latest", F.col("cohort_month") == latest)
    rate = F.col("retention_rate_pct")
    return marked.agg(
        F.max(F.when(F.col("_is_latest"), rate)).alias("latest_pct"),
        F.array_sort(F.collect_list(F.when(~F.col("_is_latest"), rate))).alias("_rates"),  # one per cohort month
    ).select("latest_pct", F.get("_rates", (F.ceil(F.size("_rates") * 0.25) - 1).cast("int")).alias("p25_pct"))


def kpi_alerts(
    ev: DataFrame, spec: AlertSpec = AlertSpec(), history: DataFrame | None = None, visits: DataFrame | None = None,
) -> DataFrame:
    """One row per rule: current value, limit, and whether it fires.

    ``visits``: the partial aggregate of the events, if it is there already. Else it is made and written, so that events are
    read for it, for single prices and (without ``history``) for cohorts. Runs Spark jobs when called.
    """
    visits = written(partials.visits(ev), "visits") if visits is None else visits
    by_session = written(partials.session_partials(visits), "session-partials")
    conversion = funnel.funnel_overall(by_session)
    abandonment = funnel.cart_abandonment(by_session)
    revenue = _latest(daily_revenue_zscore(visits, sigmas=spec.revenue_sigmas), "event_date")
    weekly = _latest(_weekly_conversion(visits).where("_complete"), "week_start")
    outliers = anomaly.price_outlier_summary(ev).agg(F.sum("outlier_count").alias("n"))
    bots = anomaly.busy_sessions(visits, spec.bot_events).agg(F.count("*").alias("n"))
    retention = latest_month1_retention(ev if history is None else history)

    def lit(value: float) -> Column:
        return F.lit(float(value))

    rules = [
        _rule(conversion, "Overall conversion rate", "overall_conversion_pct", lit(spec.conversion_floor_pct),
              F.col("overall_conversion_pct") < spec.conversion_floor_pct),
        _rule(abandonment, "Cart abandonment rate", "abandonment_rate_pct", lit(spec.abandonment_ceiling_pct),
              F.col("abandonment_rate_pct") > spec.abandonment_ceiling_pct),
        _rule(revenue, "Daily revenue", "z_score", lit(spec.revenue_sigmas),
              F.col("anomaly_flag").isin(vocab.FLAG_LOW, vocab.FLAG_HIGH)),
        _rule(weekly, "Top-category conversion", "change_pct", lit(-spec.weekly_drop_pct),
              F.col("change_pct") < -spec.weekly_drop_pct),
        _rule(outliers, "Price outlier count", "n", lit(spec.outlier_baseline), F.col("n") > spec.outlier_baseline),
        _rule(bots, "Bot session count", "n", lit(spec.bot_baseline), F.col("n") > spec.bot_baseline),
        _rule(retention, "Month-1 cohort retention", "latest_pct", F.col("p25_pct"),
              F.col("latest_pct") < F.col("p25_pct")),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.union(rule)
    return out
