"""Retention of acquisition cohorts (buyers grouped by the month of their first purchase)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab


def _active_users(ev: DataFrame) -> DataFrame:
    """Users per (first month, months since): one shuffle by user.

    A user's set of active months has at most as many entries as the data has
    calendar months, and is collected on the map side first. Every user is
    active in the first month, so that row also gives the size of the cohort.
    """
    month = C.month_number()
    per_user = (
        ev.where(C.is_type(vocab.PURCHASE))
        .groupBy("user_id")
        .agg(F.min(month).alias("cohort"), F.collect_set(month).alias("months"))
    )
    active = per_user.select("cohort", F.explode("months").alias("month")).select(
        "cohort", (F.col("month") - F.col("cohort")).alias("months_since_first")
    )
    return active.groupBy("cohort", "months_since_first").agg(F.count("*").alias("active_users"))


def _cohort_rows(ev: DataFrame) -> DataFrame:
    size = F.max(F.when(F.col("months_since_first") == 0, F.col("active_users"))).over(W.partitionBy("cohort"))
    return _active_users(ev).withColumn("cohort_users", size)


def cohort_retention(ev: DataFrame) -> DataFrame:
    """Long form; only months that can be and were observed have a row."""
    return (
        _cohort_rows(ev)
        .select(
            C.month_text(F.col("cohort")).alias("cohort_month"),
            "cohort_users",
            "months_since_first",
            "active_users",
            C.pct(F.col("active_users"), F.col("cohort_users")).alias("retention_rate_pct"),
        )
        .orderBy("cohort_month", "months_since_first")
    )


def cohort_matrix(ev: DataFrame, months: int = 6) -> DataFrame:
    """One row per cohort, a column per month since; months without buyers read 0.0, also unobserved ones."""

    def share(offset: int):
        active = F.max(F.when(F.col("months_since_first") == offset, F.col("active_users")))
        return C.pct(F.coalesce(active, F.lit(0)), F.max("cohort_users"), 1).alias(f"m{offset}_pct")

    return (
        _cohort_rows(ev)
        .groupBy("cohort")
        .agg(F.max("cohort_users").alias("cohort_users"), *[share(o) for o in range(months + 1)])
        .orderBy("cohort")
        .withColumn("cohort", C.month_text(F.col("cohort")))
        .withColumnRenamed("cohort", "cohort_month")
    )


def cohort_matrix_nullable(ev: DataFrame, months: int = 6) -> DataFrame:
    """As ``cohort_matrix``, but cells nobody could observe stay NULL."""
    offsets = list(range(months + 1))
    wide = (
        cohort_retention(ev)
        .groupBy("cohort_month")
        .pivot("months_since_first", offsets)
        .agg(F.first("retention_rate_pct"))
        .orderBy("cohort_month")
    )
    return wide.select("cohort_month", *[F.col(str(o)).alias(f"m{o}_pct") for o in offsets])


def retention_curve(ev: DataFrame) -> DataFrame:
    return curve_of(cohort_retention(ev))


def curve_of(retention: DataFrame) -> DataFrame:
    """Unweighted mean, lowest and highest cohort rate per month since the first purchase."""
    return (
        retention.groupBy("months_since_first")
        .agg(
            F.count("*").alias("cohorts_with_data"),
            C.exact_mean(F.col("retention_rate_pct")).alias("avg_retention_pct"),
            F.round(F.min("retention_rate_pct"), 2).alias("min_retention_pct"),
            F.round(F.max("retention_rate_pct"), 2).alias("max_retention_pct"),
        )
        .orderBy("months_since_first")
    )
