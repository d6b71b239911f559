"""Recency, frequency, monetary segmentation of buyers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions.quantiles import quantiles, value_counts
from clickloom.operators.ranking import Score, add_ntiles

REFERENCE_DATE = date(2020, 5, 1)


def rfm_raw(ev: DataFrame, reference_date: date = REFERENCE_DATE) -> DataFrame:
    """Per buyer: days since the last purchase, number of purchases, total spent."""
    return (
        ev.where(C.holds_priced(ev))
        .groupBy("user_id")
        .agg(
            F.date_diff(F.lit(reference_date), F.max(C.day(ev))).alias("recency_days"),
            C.n_priced(ev).alias("frequency"),
            C.amount(C.revenue(ev), None).alias("monetary"),
        )
    )


def rfm_scores(raw: DataFrame, k: int = 5) -> DataFrame:
    """Scores 1..k, k = best: most recent, most frequent, highest spending."""
    scores = [
        Score("r_score", -F.col("recency_days")),
        Score("f_score", F.col("frequency")),
        Score("m_score", F.col("monetary")),
    ]
    return add_ntiles(raw, scores, "user_id", k)


def rfm_segments(ev: DataFrame, reference_date: date = REFERENCE_DATE) -> DataFrame:
    scored = rfm_scores(rfm_raw(ev, reference_date))
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    # The published segment rules; the first that holds decides.
    segment = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champion")
        .when((r >= 3) & (f >= 3), "Loyal")
        .when((r >= 4) & (f <= 2), "Recent but Infrequent")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r == 1) & (f == 1), "Lost")
        .otherwise("Others")
    )
    return scored.select(
        "user_id",
        "recency_days",
        "frequency",
        F.round("monetary", 2).alias("monetary"),
        "r_score",
        "f_score",
        "m_score",
        (r + f + m).alias("rfm_total"),
        segment.alias("segment"),
    )


def rfm_preview(segments: DataFrame, n: int = 1000) -> DataFrame:
    """The best customers."""
    return segments.orderBy(F.desc("rfm_total"), "user_id").limit(n)


def rfm_distribution(segments: DataFrame) -> DataFrame:
    """Size and value of each segment. The shares' window runs over one row per segment."""
    everyone = W.partitionBy()
    by_segment = segments.groupBy("segment").agg(
        F.count("*").alias("user_count"),
        F.round(F.avg("recency_days"), 1).alias("avg_recency_days"),
        F.round(F.avg("frequency"), 2).alias("avg_frequency"),
        C.exact_mean(F.col("monetary")).alias("avg_monetary"),
        F.sum("monetary").alias("_revenue"),
    )
    return by_segment.select(
        "segment",
        "user_count",
        C.pct(F.col("user_count"), F.sum("user_count").over(everyone)).alias("pct_of_users"),
        "avg_recency_days",
        "avg_frequency",
        "avg_monetary",
        F.round("_revenue", 2).alias("total_revenue"),
        C.pct(F.col("_revenue"), F.sum("_revenue").over(everyone)).alias("pct_of_revenue"),
    ).orderBy(F.desc("avg_monetary"), "segment")


def rfm_monetary_percentiles(segments: DataFrame) -> DataFrame:
    """Exact percentiles per segment. Runs a Spark job when called: the counts of different values are written."""
    counts = value_counts(segments, ["segment"], "monetary")
    out = segments.groupBy("segment").agg(
        F.count("*").alias("user_count"),
        C.exact_mean(F.col("monetary")).alias("avg_monetary"),
        F.round(F.max("monetary"), 2).alias("max_monetary"),
    )
    return out.join(quantiles(counts, ["segment"], "monetary", [0.25, 0.5, 0.75, 0.9]), "segment").select(
        "segment",
        "user_count",
        F.round(F.col("q")[0], 2).alias("p25_monetary"),
        F.round(F.col("q")[1], 2).alias("median_monetary"),
        F.round(F.col("q")[2], 2).alias("p75_monetary"),
        F.round(F.col("q")[3], 2).alias("p90_monetary"),
        "avg_monetary",
        "max_monetary",
    ).orderBy(F.desc("median_monetary"), "segment")
