"""Partial aggregates: same results as from events, few scans, exact money."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab
from clickloom.operators import anomaly, category, experiment, funnel, partials, rfm, sessions
from clickloom.plans import alerts, mart, measures
from clickloom.plans.catalog import ALERTS, CATEGORY_SPEC, MART, QUERIES, SPEC
from clickloom.sources import fixture
from clickloom.sources.stable import written
from frames import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark):
    ev = written(fixture.full_events(spark, FOLDER), "partials-test")
    return ev, written(partials.visits(ev), "partials-test-visits")


OPERATORS = {
    "funnel_overall": funnel.funnel_overall, "cart_abandonment": funnel.cart_abandonment,
    "direct_checkout": funnel.direct_checkout, "without_view": funnel.sessions_without_view,
    "funnel_by_category": lambda ev: funnel.funnel_by_category(ev, 10), "funnel_by_brand": lambda ev: funnel.funnel_by_brand(ev, 10),
    "summary": sessions.session_summary, "depth": sessions.session_depth_buckets, "profile": sessions.session_profile,
    "stats": sessions.session_stats, "rfm": rfm.rfm_raw,
    "category": lambda ev: category.category_performance(ev, 10), "brands": lambda ev: category.brand_ranking(ev, 5),
    "volume": anomaly.daily_volume_zscore, "weekly": anomaly.weekly_category_shift, "busy": lambda ev: anomaly.busy_sessions(ev, 10),
    "period_funnel": lambda ev: experiment.period_funnel(ev, SPEC), "weekly_trend": lambda ev: experiment.weekly_trend(ev, SPEC),
    "mix": lambda ev: experiment.category_mix_shift(ev, CATEGORY_SPEC), "new": lambda ev: experiment.new_vs_returning(ev, SPEC),
    "kpis": measures.overview_kpis, "revenue": alerts.daily_revenue_zscore, "top_conversion": alerts.weekly_top_category_conversion,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_partials_finish_like_events(both, name):
    ev, visits = both
    result = OPERATORS[name]
    assert sorted(rows(result(visits)), key=repr) == sorted(rows(result(ev)), key=repr)


def test_coarser_partials_finish_like_finer_ones(both):
    ev, visits = both
    coarse = partials.session_partials(visits)
    for operator in (funnel.funnel_overall, sessions.session_summary, sessions.session_profile, sessions.session_depth_buckets):
        assert rows(operator(coarse)) == rows(operator(ev))
    assert sorted(rows(partials.merged(visits, ["brand"])), key=repr) == sorted(rows(partials.merged(ev, ["brand"])), key=repr)


def _executions(spark):
    return spark._jsparkSession.sharedState().statusStore()


def _scans(spark, since, path):
    """How often the files below ``path`` are scanned by the executions after the first ``since``, by their final plans."""
    store, count = _executions(spark), 0
    executions = store.executionsList()
    for i in range(since, executions.size()):
        nodes = store.planGraph(executions.apply(i).executionId()).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            count += node.name().startswith("Scan parquet") and path in node.desc()
    return count


@pytest.mark.parametrize("most, build", [
    (4, lambda spark, ev, path: alerts.kpi_alerts(ev, ALERTS).collect()),
    (8, lambda spark, ev, path: mart.build_mart(ev, path, MART)),
    (6, lambda spark, ev, path: mart.build_mart(ev, path, MART, fixture.order_events(spark, FOLDER))),
])
def test_events_are_scanned_few_times(spark, tmp_path, most, build):
    path = str(tmp_path / "e")
    fixture.full_events(spark, FOLDER).write.parquet(path)
    ev = spark.read.parquet(path)
    since = _executions(spark).executionsList().size()
    ev.groupBy("brand").count().collect()
    assert _scans(spark, since, path) == 1  # the counter sees scans
    since = _executions(spark).executionsList().size()
    build(spark, ev, str(tmp_path / "mart"))
    assert 1 <= _scans(spark, since, path) <= most


def test_insights_scan_events_twice(spark, both):
    """Once for the visits and once for products viewed; the stored visits of this folder may be there already."""
    QUERIES["measure_insights"](spark, FOLDER).collect()
    path = fixture.stored_events(spark, FOLDER).inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    since = _executions(spark).executionsList().size()
    QUERIES["measure_insights"](spark, FOLDER).collect()
    assert _scans(spark, since, path) <= 6


def test_money_is_exact_however_rows_are_dealt(spark):
    """Amounts of very different size: sums of doubles would differ in their last digits, or lose the small ones."""
    draw = random.Random(11)
    start = datetime(2024, 1, 1)
    prices = [draw.choice((0.01, 0.1, 0.07, 33333333.33, 1e13 + 0.5, 1e15)) for _ in range(3000)]
    data = [(i, start + timedelta(minutes=7 * i), "purchase", p, i % 5, f"s{i % 40}", "a.b", f"b{i % 3}", i % 7) for i, p in enumerate(prices)]
    ev = spark.createDataFrame(data, "event_id long, event_time timestamp, event_type string, price double, user_id long, user_session string, category_code string, brand string, product_id long")
    want = float(sum(Decimal(repr(p)) for p in prices))
    results = {
        "brands": lambda e: category.brand_ranking(e, 0), "rfm": rfm.rfm_raw, "category": category.category_counts,
        "trend": category.monthly_category_trend, "revenue": alerts.daily_revenue_zscore, "kpis": measures.overview_kpis,
        "mix": lambda e: experiment.category_mix(e, CATEGORY_SPEC), "behaviour": lambda e: experiment.period_session_behavior(e, SPEC),
        "funnel": lambda e: experiment.period_funnel(e, SPEC), "weekly": lambda e: anomaly.weekly_category_shift(e, {"a": "a"}),
        "busy": lambda e: anomaly.high_frequency_sessions(e, 5),
    }
    dealt = [ev.coalesce(1), ev.repartition(7, "event_id"), ev.repartition(13, F.rand(3))]
    for name, operator in results.items():
        first, *others = [sorted(rows(operator(e)), key=repr) for e in dealt]
        assert first and all(other == first for other in others), name
    assert category.category_counts(ev).first()["total_revenue"] == round(want, 2)
    assert ev.agg(C.total(F.col("price")).alias("t")).first()["t"] == want
    assert ev.agg(C.revenue(ev).alias("t")).first()["t"] == sum(Decimal(repr(p)) for p in prices)
    assert vocab.PURCHASE == "purchase"
