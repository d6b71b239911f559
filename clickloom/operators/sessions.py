"""Sessions: depth, duration, conversion and the position of purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab
from clickloom.functions.quantiles import quantiles, value_counts
from clickloom.functions.ranges import RANGE_ROWS, positions
from clickloom.sources.stable import written

# Width of the time slices that spread the events of one busy session or user over many tasks.
SLICE_SECONDS = 900


def sessionize(ev: DataFrame, gap_seconds: int, key: str = "user_id") -> DataFrame:
    """Add ``user_session`` to events that lack it: a pause longer than the gap starts a new session.

    A slice of time no wider than the gap cannot hold a pause longer than the
    gap, so a session can only start with the first event of a slice. Events are
    therefore first reduced to one row per (user, slice); the window per user
    runs over those rows only, and no task ever sorts all events of a busy user.
    Events without a ``key`` stay and have no session.
    """
    width = min(gap_seconds, SLICE_SECONDS)
    sliced = ev.withColumn("_slice", C.time_slice(width))
    slices = sliced.groupBy(key, "_slice").agg(
        F.min("event_time").alias("_first"), F.max("event_time").alias("_last")
    )
    by_user = W.partitionBy(key).orderBy("_slice")
    pause = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(by_user))
    starts = slices.withColumn("_new", F.when(pause <= gap_seconds * 1_000_000, 0).otherwise(1))
    session = F.when(F.col(key).isNotNull(), F.concat_ws("-", F.col(key), F.sum("_new").over(by_user)))
    numbered = starts.where(F.col(key).isNotNull()).select(key, "_slice", session.alias("user_session"))
    return sliced.join(numbered, [key, "_slice"], "left").drop("_slice")


def session_stats(ev: DataFrame) -> DataFrame:
    """One row per session. A missing session id is a group of its own."""
    return (
        ev.groupBy("user_session")
        .agg(
            C.n_events(ev).alias("total_events"),
            C.n_type(ev, vocab.VIEW).alias("views"),
            C.n_type(ev, vocab.CART).alias("carts"),
            C.n_type(ev, vocab.PURCHASE).alias("purchases"),
            C.first_time(ev).alias("session_start"),
            C.last_time(ev).alias("session_end"),
        )
        .withColumn("session_duration_seconds", C.seconds_between(F.col("session_start"), F.col("session_end")))
        .withColumn("converted", F.when(F.col("purchases") > 0, 1).otherwise(0))
    )


SECONDS = "session_duration_seconds"


def _cells(ev: DataFrame) -> DataFrame:
    """Sessions counted by conversion, events and seconds: all that means and quantiles need. Written, and never wider than
    the sessions are different."""
    cells = session_stats(ev).groupBy("converted", "total_events", SECONDS).agg(
        F.count("*").alias("n"), F.sum("views").alias("views"), F.sum("carts").alias("carts")
    )
    return written(cells.withColumn("_all", F.lit(1)), "session-cells")


def _counts(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    return cells.groupBy(*by, value).agg(F.sum("n").alias("n"))


def _mean(value: str):
    return C.ratio(F.sum(F.col(value) * F.col("n")), F.sum("n"))


def session_summary(ev: DataFrame) -> DataFrame:
    """One row over all sessions, with exact quantiles. Runs a Spark job when called: counts of sessions are written."""
    cells = _cells(ev)
    rows = cells.count()
    events_q = quantiles(_counts(cells, ["_all"], "total_events"), ["_all"], "total_events", [0.5, 0.9, 0.95], rows)
    seconds_q = quantiles(_counts(cells, ["_all"], SECONDS), ["_all"], SECONDS, [0.5], rows)
    n = F.sum("n")
    buyers = F.coalesce(F.sum(F.when(F.col("converted") == 1, F.col("n"))), F.lit(0).cast("long"))
    out = cells.groupBy("_all").agg(
        n.alias("total_sessions"),
        F.round(_mean("total_events"), 2).alias("avg_events_per_session"),
        F.round(_mean(SECONDS), 0).alias("avg_duration_seconds"),
        buyers.alias("purchasing_sessions"),
        (n - buyers).alias("non_purchasing_sessions"),
    )
    out = out.join(events_q.withColumnRenamed("q", "_events"), "_all").join(seconds_q.withColumnRenamed("q", "_seconds"), "_all")
    return out.select(
        "total_sessions",
        "avg_events_per_session",
        F.col("_events")[0].alias("median_events"),
        F.col("_events")[1].alias("p90_events"),
        F.col("_events")[2].alias("p95_events"),
        "avg_duration_seconds",
        F.col("_seconds")[0].alias("median_duration_seconds"),
        "purchasing_sessions",
        "non_purchasing_sessions",
        C.pct(F.col("purchasing_sessions"), F.col("total_sessions")).alias("purchase_session_pct"),
    )


def depth_bucket(events: str = "total_events"):
    """Label of the bucket a session's event count falls into."""
    count = F.col(events)
    *closed, (_, last) = vocab.DEPTH_BUCKETS
    (top, label), *rest = closed
    out = F.when(count <= top, label)
    for top, label in rest:
        out = out.when(count <= top, label)
    return out.otherwise(last)


def session_depth_buckets(ev: DataFrame) -> DataFrame:
    stats = ev.groupBy("user_session").agg(
        C.n_events(ev).alias("total_events"), C.has(ev, vocab.PURCHASE).alias("converted")
    )
    out = stats.groupBy(depth_bucket().alias("event_bucket")).agg(
        F.count("*").alias("total_sessions"),
        F.sum("converted").alias("purchasing_sessions"),
        F.sum(1 - F.col("converted")).alias("non_purchasing_sessions"),
    )
    return out.withColumn(
        "conversion_rate_pct", C.pct(F.col("purchasing_sessions"), F.col("total_sessions"))
    ).orderBy("event_bucket")


def purchase_ranks(ev: DataFrame, slice_seconds: int = SLICE_SECONDS, slice_events: int = RANGE_ROWS) -> DataFrame:
    """Position of every purchase among the events of its session.

    The position is the number of events in earlier time slices of the session (a window over one row per slice) plus the
    position inside the slice. Only events of sessions with a purchase are looked at, only slices that hold one are sorted,
    and a session with a third of all events is spread over as many groups as it has slices. A slice of more than
    ``slice_events`` events, up to a session that has all of them in one second, is cut further by time and id
    (``ranges.positions``). Runs Spark jobs when called: the slices are counted and written.
    """
    shown = C.tie_columns(ev)
    named = ev.where(F.col("user_session").isNotNull())
    buying = named.where(C.is_type(vocab.PURCHASE)).select("user_session").distinct()
    named = named.join(buying, "user_session", "left_semi").withColumn("_slice", C.time_slice(slice_seconds))
    slices = named.groupBy("user_session", "_slice").agg(
        F.count("*").alias("_events"), C.has_type(vocab.PURCHASE).alias("_buys")
    )
    earlier = W.partitionBy("user_session").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = written(
        slices.withColumn("_before", F.coalesce(F.sum("_events").over(earlier), F.lit(0))).where(F.col("_buys") == 1), "slices")
    is_large = F.col("_events") > slice_events
    large = carried.where(is_large).agg(F.coalesce(F.sum("_events"), F.lit(0))).first()[0]
    keys = ["user_session", "_slice"]
    columns = named.select(*keys, *dict.fromkeys(["event_type", *shown]))
    small = columns.join(carried.where(~is_large).select(*keys, "_before"), keys)
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*C.tie_order(ev)))
    ranked = small.withColumn("event_rank", F.col("_before") + inside)
    if large:
        crowded = columns.join(carried.where(is_large).select(*keys, "_before"), keys)
        crowded = positions(crowded, keys, C.tie_order(ev), large, slice_events)
        ranked = ranked.unionByName(crowded.withColumn("event_rank", F.col("_before") + F.col("_position")).drop("_position"))
    return ranked.where(C.is_type(vocab.PURCHASE)).select("user_session", *shown, "event_rank")


def depth_at_purchase(ev: DataFrame) -> DataFrame:
    """How deep in their sessions purchases happen. Runs Spark jobs when called: ranks are counted and written."""
    counts = value_counts(purchase_ranks(ev).withColumn("_all", F.lit(1)), ["_all"], "event_rank")
    mean = C.ratio(F.sum(F.col("event_rank") * F.col("n")), F.sum("n"), 2)
    out = counts.groupBy("_all").agg(
        mean.alias("avg_event_rank_at_purchase"), F.max("event_rank").alias("max_event_rank_at_purchase")
    )
    return out.join(quantiles(counts, ["_all"], "event_rank", [0.25, 0.5, 0.75, 0.9]), "_all").select(
        F.col("q")[0].alias("p25_event_rank_at_purchase"),
        F.col("q")[1].alias("median_event_rank_at_purchase"),
        F.col("q")[2].alias("p75_event_rank_at_purchase"),
        F.col("q")[3].alias("p90_event_rank_at_purchase"),
        "avg_event_rank_at_purchase",
        "max_event_rank_at_purchase",
    )


def session_profile(ev: DataFrame) -> DataFrame:
    """Converting against other sessions. Runs a Spark job when called: counts of sessions are written."""
    cells = _cells(ev)
    rows = cells.count()
    events_q = quantiles(_counts(cells, ["converted"], "total_events"), ["converted"], "total_events", [0.5], rows)
    seconds_q = quantiles(_counts(cells, ["converted"], SECONDS), ["converted"], SECONDS, [0.5], rows)
    return (
        cells.groupBy("converted")
        .agg(
            F.sum("n").alias("session_count"),
            F.round(_mean("total_events"), 2).alias("avg_total_events"),
            C.ratio(F.sum("views"), F.sum("n"), 2).alias("avg_views"),
            C.ratio(F.sum("carts"), F.sum("n"), 2).alias("avg_carts"),
            F.round(_mean(SECONDS) / 60.0, 2).alias("avg_duration_minutes"),
        )
        .join(events_q.select("converted", F.col("q")[0].alias("median_total_events")), "converted")
        .join(seconds_q.select("converted", F.round(F.col("q")[0] / 60.0, 2).alias("median_duration_minutes")), "converted")
        .orderBy(F.desc("converted"))
        .select(
            F.when(F.col("converted") == 1, "Converting").otherwise("Non-Converting").alias("session_type"),
            "session_count",
            "avg_total_events",
            "median_total_events",
            "avg_views",
            "avg_carts",
            "avg_duration_minutes",
            "median_duration_minutes",
        )
    )
