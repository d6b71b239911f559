"""Data that once gave wrong results: equal times, missing keys, money, empty periods, exact thresholds."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.functions.periods import PeriodSpec
from clickloom.operators import anomaly, experiment, propensity, sessions
from clickloom.plans import alerts

START = datetime(2019, 10, 1, 12)


def history(spark, rows, schema):
    ev = spark.createDataFrame(rows, schema)
    return {r["user_session"]: r["prior_purchase_count"] for r in propensity.propensity_features(ev).collect()}


def test_own_purchase_of_the_opening_second_is_no_history(spark):
    at = lambda tenths: START + timedelta(milliseconds=100 * tenths)
    rows = [(9, at(1), "view", 1), (3, at(5), "purchase", 2), (10, at(600), "view", 3), (11, at(700), "view", 4)]
    rows = [(i, t, k, p, "a.b", "x", 5.0, 7, "s") for i, t, k, p in rows]
    schema = ("event_id long, event_time timestamp, event_type string, product_id long, category_code string, brand string, "
              "price double, user_id long, user_session string")
    assert history(spark, rows, schema) == {"s": 0}
    earlier = [(1, START - timedelta(days=2), "purchase", 5, "a.b", "x", 5.0, 7, "t")] * 2
    assert history(spark, rows + earlier, schema) == {"s": 2}


def test_own_purchase_at_the_opening_time_without_event_id(spark):
    rows = [(START, "cart", 9), (START, "purchase", 3), (START + timedelta(minutes=1), "view", 3), (START + timedelta(minutes=2), "view", 3)]
    rows = [(t, k, p, "a.b", "x", 5.0, 7, "s") for t, k, p in rows]
    schema = "event_time timestamp, event_type string, product_id long, category_code string, brand string, price double, user_id long, user_session string"
    assert history(spark, rows, schema) == {"s": 0}


def test_equal_times_follow_the_funnel(spark):
    ev = spark.createDataFrame([(START, k, 1, 5.0, "s") for k in ("purchase", "cart", "view")],
                               "event_time timestamp, event_type string, product_id long, price double, user_session string")
    assert [r["event_rank"] for r in sessions.purchase_ranks(ev).collect()] == [3]


def test_events_without_user_stay(spark):
    ev = spark.createDataFrame([(START, None), (START, 1)], "event_time timestamp, user_id long")
    assert sorted((r["user_id"] or 0, r["user_session"]) for r in sessions.sessionize(ev, 60).collect()) == [(0, None), (1, "1-1")]


def test_long_sessions_without_keys(spark):
    ev = spark.createDataFrame([(START, "view", i % 2, 1.0, None, None) for i in range(5)],
                               "event_time timestamp, event_type string, product_id long, price double, user_id long, user_session string")
    r = anomaly.high_frequency_sessions(ev, 4).first()
    assert (r["events_in_session"], r["distinct_products"]) == (5, 2)


def scored(spark, rows):
    return spark.createDataFrame(rows, f"purchase_prob double, {propensity.LABEL} int, user_session string")


def test_exact_roc_thresholds(spark):
    rows = [(p / 100, 1, str(p)) for p in (0, 28, 29, 57, 58, 100)] + [(0.5, 0, "n")]
    curve = {round(r["threshold"] * 100): r["true_positives"] for r in propensity.roc_curve(scored(spark, rows)).collect()}
    assert sorted(curve) == list(range(101))
    assert [curve[t] for t in (0, 28, 29, 30, 57, 58, 59, 100)] == [6, 5, 4, 3, 3, 2, 1, 1]


def test_exact_area(spark):
    rows = [((i * 7919 % 5000) / 5000, int(i * 31 % 97 < 20), str(i)) for i in range(4000)] + [(0.25, 1, "a"), (0.25, 0, "b")]
    pos, neg = [p for p, y, _ in rows if y], sorted(p for p, y, _ in rows if not y)
    from bisect import bisect_left, bisect_right
    won = sum((bisect_left(neg, p) + bisect_right(neg, p)) / 2 for p in pos)
    assert math.isclose(propensity.roc_area(scored(spark, rows)).first()["area"], won / len(pos) / len(neg), rel_tol=1e-12)
    assert propensity.evaluate_propensity(scored(spark, [(0.2, 1, "a"), (0.7, 1, "b")])).first()["roc_auc"] is None


def test_training_without_any_history(spark):
    rows = [(f"s{i}", 1 + i % 3, 1, 1.0, 2.0, 1.5, i % 2, 3, 4, False, 0, None, i % 7 < 3, False) for i in range(80)]
    frame = spark.createDataFrame(rows, (
        "user_session string, products_viewed long, categories_viewed long, min_price_viewed double, max_price_viewed double, "
        "avg_price_viewed double, cart_in_cutoff int, session_start_hour int, session_start_dow int, is_returning_user boolean, "
        "prior_purchase_count long, days_since_last_purchase int, purchased_after_cutoff boolean, is_covid_period boolean"))
    model = propensity.fit_propensity(frame)
    assert propensity.score_sessions(model, frame).where("purchase_prob IS NULL OR isnan(purchase_prob)").count() == 0
    with pytest.raises(RuntimeError):
        propensity.fit_propensity(frame, max_iter=1)


def test_small_money_is_not_rounded_away(spark):
    days = [(START + timedelta(days=d), v) for d, v in enumerate([0.15, 0.14, 0.16, 0.15, 0.15, 0.14, 0.16, 9.9])]
    ev = spark.createDataFrame([(t, "purchase", v) for t, v in days], "event_time timestamp, event_type string, price double")
    last = alerts.daily_revenue_zscore(ev).orderBy(F.desc("event_date")).first()
    assert last["anomaly_flag"].startswith("HIGH") and last["z_score"] > 100


def test_period_without_sessions(spark):
    spec = PeriodSpec()
    funnel = spark.createDataFrame([(spec.pre_label, 5, 10), (spec.onset_label, 0, 0)], "period string, purchase_sessions long, total_sessions long")
    z, effect = experiment.two_proportion_ztest(funnel, spec).first(), experiment.proportion_effect(funnel, spec).first()
    assert z["z_stat"] is None and z["p_value"] is None and effect["delta_pp"] is None


def test_normal_tail(spark):
    zs = [-9.0, -4.5, -3.0, -1.0, -1e-9, 0.0, 0.3, 1.0, 1.96, 3.0, 4.2, 4.25, 5.0, 8.0, 20.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", experiment.upper_normal_tail(F.col("z")).alias("p")).collect()
    for r in rows:
        want = 0.5 * math.erfc(r["z"] / math.sqrt(2))
        assert math.isclose(r["p"], want, rel_tol=1e-9, abs_tol=1e-15), (r["z"], r["p"], want)
