"""View, cart and purchase funnels counted in sessions.

Each funnel reduces events to one row of stage flags per (group, session) and
then adds the flags up. Compared with several COUNT(DISTINCT ...) this needs no
row expansion, and events of a large group are reduced before they move. All
take events or a partial aggregate (``partials``) with the keys they group by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab


def session_flags(ev: DataFrame, by: dict[str, Column] | None = None) -> DataFrame:
    """Stages reached per session (and group); events without a session cannot be counted."""
    keys = [column.alias(name) for name, column in (by or {}).items()]
    return (
        ev.where(F.col("user_session").isNotNull())
        .groupBy(*keys, "user_session")
        .agg(
            C.has(ev, vocab.VIEW).alias("viewed"),
            C.has(ev, vocab.CART).alias("carted"),
            C.has(ev, vocab.PURCHASE).alias("purchased"),
        )
    )


def _stage_counts(flags: DataFrame, by: list[str], names: tuple[str, str, str]) -> DataFrame:
    views, carts, purchases = names
    zero = F.lit(0).cast("long")
    return flags.groupBy(*by).agg(
        F.coalesce(F.sum("viewed"), zero).alias(views),
        F.coalesce(F.sum("carted"), zero).alias(carts),
        F.coalesce(F.sum("purchased"), zero).alias(purchases),
    )


def _with_rates(counts: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    views, carts, purchases = (F.col(n) for n in names)
    return (
        counts.withColumn("view_to_cart_pct", C.pct(carts, views))
        .withColumn("cart_to_purchase_pct", C.pct(purchases, carts))
        .withColumn("overall_conversion_pct", C.pct(purchases, views))
    )


def funnel_overall(ev: DataFrame) -> DataFrame:
    names = ("sessions_with_view", "sessions_with_cart", "sessions_with_purchase")
    return _with_rates(_stage_counts(session_flags(ev), [], names), names)


def _funnel_by(ev: DataFrame, name: str, column: Column, min_views: int) -> DataFrame:
    names = ("views", "carts", "purchases")
    counts = _stage_counts(session_flags(ev, {name: column}), [name], names)
    return _with_rates(counts.where(F.col("views") > min_views), names)


def funnel_by_category(ev: DataFrame, min_views: int = 1000, n: int = 20) -> DataFrame:
    out = _funnel_by(ev, "top_category", C.category(ev), min_views)
    return out.orderBy(F.desc("overall_conversion_pct"), "top_category").limit(n)


def funnel_by_brand(ev: DataFrame, min_views: int = 1000, n: int = 20) -> DataFrame:
    branded = ev.where(F.col("brand").isNotNull())
    out = _funnel_by(branded, "brand", F.col("brand"), min_views)
    return out.orderBy(F.desc("purchases"), "brand").limit(n)


def cart_abandonment(ev: DataFrame) -> DataFrame:
    carts = session_flags(ev).where(F.col("carted") == 1)
    zero = F.lit(0).cast("long")
    counts = carts.agg(
        F.count("*").alias("total_cart_sessions"),
        F.coalesce(F.sum("purchased"), zero).alias("converted_cart_sessions"),
    )
    abandoned = F.col("total_cart_sessions") - F.col("converted_cart_sessions")
    return counts.withColumn("abandoned_cart_sessions", abandoned).withColumn(
        "abandonment_rate_pct", C.pct(abandoned, F.col("total_cart_sessions"))
    )


def direct_checkout(ev: DataFrame) -> DataFrame:
    """Sessions that purchase without ever using the cart."""
    bought = session_flags(ev).where(F.col("purchased") == 1)
    zero = F.lit(0).cast("long")
    counts = bought.agg(
        F.count("*").alias("purchase_sessions"),
        F.coalesce(F.sum(1 - F.col("carted")), zero).alias("direct_purchase_sessions"),
    )
    return counts.withColumn(
        "direct_purchase_pct", C.pct(F.col("direct_purchase_sessions"), F.col("purchase_sessions"))
    )


def sessions_without_view(ev: DataFrame) -> DataFrame:
    """Sessions with a cart or purchase but no logged view: traffic the funnel's top misses."""
    zero = F.lit(0).cast("long")
    counts = session_flags(ev).agg(
        F.count("*").alias("total_sessions"),
        F.coalesce(F.sum("viewed"), zero).alias("view_sessions"),
    )
    missing = F.col("total_sessions") - F.col("view_sessions")
    return counts.withColumn("sessions_without_view", missing).withColumn(
        "without_view_pct", C.pct(missing, F.col("total_sessions"))
    )
