"""Partial aggregates of events that can be merged further, and finished by most operators as if they were events.

A partial has some of the key columns ``user_session``, ``user_id``, ``event_date``, ``top_category`` and ``brand``, and for
each key the number of events, of each type and of priced purchases, the exact revenue, and the first and last time.
``visits`` is the finest one; ``merged`` makes coarser ones from events or from finer ones. Computed once and written, one
``visits`` table answers funnels, depth, profile, RFM, category, brand, volume, period and alert questions without
another look at the events. What needs single prices or products (outliers, products viewed) still reads events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab

VISIT = ("user_session", "user_id", "event_date", "top_category", "brand")


def merged(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per key of ``by``, from events or from a partial that has these keys."""
    made = {"event_date": C.day(df), "top_category": C.category(df)}
    return df.groupBy(*[made.get(key, F.col(key)).alias(key) for key in by]).agg(
        C.n_events(df).alias("events"),
        *[C.n_type(df, kind).alias(C.stage_column(kind)) for kind in vocab.EVENT_TYPES],
        C.n_priced(df).alias("priced_purchases"),
        C.revenue(df).alias("revenue"),
        C.first_time(df).alias("first_time"),
        C.last_time(df).alias("last_time"),
    )


def visits(ev: DataFrame) -> DataFrame:
    """One row per session, user, day, category and brand."""
    return merged(ev, VISIT)


def session_partials(visits: DataFrame) -> DataFrame:
    """One row per session."""
    return merged(visits, ["user_session"])
