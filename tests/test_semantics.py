"""Edge cases on small hand-made frames."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions.periods import PeriodSpec
from clickloom.operators import anomaly, category, cohort, experiment, funnel, propensity, rfm, sessions
from frames import rows

SPEC = PeriodSpec(pre_end=date(2024, 1, 10), onset_start=date(2024, 1, 12), excluded=(date(2024, 1, 5),))


def test_missing_session_counts_as_group_but_not_in_funnels(events):
    ev = events([
        ("2024-01-01 10:00", "view", 1, "a"),
        ("2024-01-01 10:01", "purchase", 1, None),
        ("2024-01-01 10:02", "view", 2, None),
    ])
    assert sessions.session_stats(ev).count() == 2
    assert sessions.session_summary(ev).first()["purchasing_sessions"] == 1
    assert funnel.funnel_overall(ev).first()["sessions_with_purchase"] == 0
    assert funnel.cart_abandonment(ev).first()["abandonment_rate_pct"] is None
    assert experiment.period_session_behavior(ev, SPEC).first()["total_sessions"] == 2
    assert experiment.period_funnel(ev, SPEC).first()["total_sessions"] == 1


def test_purchase_sessions_are_converted_carts_plus_direct_ones(events):
    ev = events([
        ("2024-01-01 10:00", "purchase", 1, "only purchase"),
        ("2024-01-01 10:00", "cart", 2, "only cart"),
        ("2024-01-01 10:00", "cart", 3, "both"), ("2024-01-01 10:01", "purchase", 3, "both"),
        ("2024-01-01 10:00", "view", 4, "view"),
    ])
    bought = funnel.funnel_overall(ev).first()["sessions_with_purchase"]
    converted = funnel.cart_abandonment(ev).first()["converted_cart_sessions"]
    direct = funnel.direct_checkout(ev).first()["direct_purchase_sessions"]
    assert (bought, converted, direct) == (2, 1, 1)
    assert rows(funnel.sessions_without_view(ev)) == [(4, 1, 3, 75.0)]


def test_category_of_missing_plain_and_deep_codes(events):
    ev = events([
        ("2024-01-01 10:00", "purchase", 1, "a", 5.0, 1, None, None),
        ("2024-01-01 10:00", "purchase", 1, "a", 0.0, 1, "sport", "x"),
        ("2024-01-01 10:00", "view", 1, "a", 5.0, 1, "sport.bike.part", "x"),
        ("2024-01-01 10:00", "view", 1, "a", 5.0, 1, None, "x"),
    ])
    found = {r["category"]: r for r in category.category_performance(ev, 0).collect()}
    assert set(found) == {"Unknown / No Category", "Sports & Outdoor"}
    assert found["Sports & Outdoor"]["total_purchases"] == 1
    assert found["Sports & Outdoor"]["total_revenue"] == 0.0  # price 0.0 is unknown, not revenue
    assert found["Sports & Outdoor"]["avg_purchase_price"] is None
    assert [r["brand"] for r in category.brand_ranking(ev, 0).collect()] == ["x"]


def test_brand_ranking_counts_categories_of_views_too(events):
    ev = events([
        ("2024-01-01 10:00", "purchase", 1, "a", 5.0, 1, "sport.a", "x"),
        ("2024-01-01 10:00", "view", 1, "a", 5.0, 2, "auto.b", "x"),
        ("2024-01-01 10:00", "view", 1, "a", 5.0, 2, "auto.c", "x"),
    ])
    row = category.brand_ranking(ev, 0).first()
    assert (row["category_count"], row["total_purchases"], row["view_to_purchase_pct"]) == (2, 1, 50.0)


def test_sessionize_splits_only_after_longer_pauses(events):
    ev = events([
        ("2024-01-01 23:50", "view", 1, None), ("2024-01-02 00:20", "view", 1, None),  # exactly 30 minutes
        ("2024-01-02 00:50:01", "view", 1, None),  # one second more
        ("2024-01-02 00:50:01", "cart", 2, None),
    ]).drop("user_session")
    got = {r["event_id"]: r["user_session"] for r in sessions.sessionize(ev, 1800).collect()}
    assert got == {0: "1-1", 1: "1-1", 2: "1-2", 3: "2-1"}


def test_purchase_rank_across_slices_and_ties(events):
    ev = events([
        ("2024-01-01 10:59", "view", 1, "a"), ("2024-01-01 11:00", "view", 1, "a"),
        ("2024-01-01 11:00", "purchase", 1, "a"), ("2024-01-01 13:00", "view", 1, "a"),
        ("2024-01-01 15:00", "purchase", 1, "a"), ("2024-01-01 15:00", "purchase", 1, None),
    ])
    assert sorted(r["event_rank"] for r in sessions.purchase_ranks(ev).collect()) == [3, 5]


@pytest.mark.parametrize("events_,bucket", [
    (1, "01: 1 event"), (2, "02: 2-5 events"), (5, "02: 2-5 events"), (6, "03: 6-10 events"), (20, "04: 11-20 events"),
    (50, "05: 21-50 events"), (51, "06: 51+ events"),
])
def test_depth_buckets(spark, events_, bucket):
    df = spark.createDataFrame([(events_,)], "total_events long")
    assert df.select(sessions.depth_bucket()).first()[0] == bucket


def test_rfm_ignores_unpriced_purchases_and_rounds_money(events):
    ev = events([
        ("2024-01-01 10:00", "purchase", 1, "a", 0.0), ("2024-01-03 10:00", "purchase", 2, "b", 1.005),
        ("2024-01-02 10:00", "purchase", 2, "b", 2.0), ("2024-01-04 10:00", "view", 3, "c"),
    ])
    assert rows(rfm.rfm_raw(ev, date(2024, 1, 10))) == [(2, 7, 2, 3.005)]
    segment = rfm.rfm_segments(ev, date(2024, 1, 10)).first()
    assert (segment["r_score"], segment["f_score"], segment["m_score"], segment["segment"]) == (1, 1, 1, "Lost")


def test_rfm_segment_order(events):
    ev = events([
        (f"2024-01-{1 + i % 28:02d} 10:00", "purchase", user, f"s{user}", 10.0 * user)
        for user in range(1, 41) for i in range(user, user + 1 + user // 8)
    ])
    out = rfm.rfm_segments(ev, date(2024, 2, 1)).collect()
    for r in out:
        rs, f, m = r["r_score"], r["f_score"], r["m_score"]
        want = (
            "Champion" if min(rs, f, m) >= 4 else "Loyal" if rs >= 3 and f >= 3
            else "Recent but Infrequent" if rs >= 4 and f <= 2 else "At Risk" if rs <= 2 and f >= 3
            else "Lost" if rs == 1 and f == 1 else "Others"
        )
        assert r["segment"] == want
    sizes = [sum(r["f_score"] == t for r in out) for t in range(1, 6)]
    assert max(sizes) - min(sizes) <= 1
    shares = rfm.rfm_distribution(rfm.rfm_segments(ev, date(2024, 2, 1))).agg(F.sum("user_count"), F.sum("pct_of_users"))
    total, pct = shares.first()
    assert total == 40 and abs(pct - 100) < 0.05


def test_unobserved_cohort_cells(events):
    ev = events([
        ("2024-01-05", "purchase", 1, "a"), ("2024-02-05", "purchase", 1, "a"), ("2024-01-06", "purchase", 2, "b"),
        ("2024-02-07", "purchase", 3, "c"), ("2024-01-07", "view", 9, "d"),
    ])
    assert rows(cohort.cohort_retention(ev)) == [
        ("2024-01", 2, 0, 2, 100.0), ("2024-01", 2, 1, 1, 50.0), ("2024-02", 1, 0, 1, 100.0),
    ]
    assert rows(cohort.cohort_matrix(ev, 1)) == [("2024-01", 2, 100.0, 50.0), ("2024-02", 1, 100.0, 0.0)]
    assert rows(cohort.cohort_matrix_nullable(ev, 1)) == [("2024-01", 100.0, 50.0), ("2024-02", 100.0, None)]
    assert rows(cohort.retention_curve(ev)) == [(0, 2, 100.0, 100.0, 100.0), (1, 1, 50.0, 50.0, 50.0)]


# Published daily counts and what was derived from them.
DAILY = [
    ("2019-10-01", 1244245, None, None, None, "Insufficient history"),
    ("2019-10-02", 1191328, 1244245.0, None, None, "Normal"),
    ("2019-10-03", 1127303, 1217787.0, 37418.0, -2.42, "LOW — potential logging gap"),
    ("2019-10-04", 1417190, 1187625.0, 58559.0, 3.92, "HIGH — unusual spike"),
    ("2019-10-05", 1330339, 1245017.0, 124343.0, 0.69, "Normal"),
    ("2019-10-06", 1318379, 1262081.0, 114244.0, 0.49, "Normal"),
    ("2019-10-07", 1200531, 1271464.0, 104736.0, -0.68, "Normal"),
    ("2019-10-08", 1370633, 1261331.0, 99298.0, 1.1, "Normal"),
    ("2019-10-09", 1347543, 1279386.0, 106875.0, 0.64, "Normal"),
    ("2019-10-10", 1284077, 1301703.0, 101603.0, -0.17, "Normal"),
    ("2019-10-11", 1495343, 1324099.0, 68706.0, 2.49, "HIGH — unusual spike"),
]


def test_published_daily_scores(spark):
    days = spark.createDataFrame([(date.fromisoformat(d), n) for d, n, *_ in DAILY], "event_date date, daily_events long")
    got = rows(anomaly.daily_zscore(days, "daily_events"))
    assert got == [(date.fromisoformat(d), *rest) for d, *rest in DAILY]


def test_constant_series_is_normal(spark):
    days = spark.createDataFrame([(date(2024, 1, d), 5) for d in range(1, 10)], "event_date date, daily_events long")
    flags = [r["anomaly_flag"] for r in anomaly.daily_zscore(days, "daily_events").collect()]
    assert flags == ["Insufficient history"] + ["Normal"] * 8
    assert all(r["z_score"] is None for r in anomaly.daily_zscore(days, "daily_events").collect())


def test_outlier_summary_keeps_categories_without_outliers(events):
    ev = events([
        ("2024-01-01 10:00", "purchase", 1, "a", p, 1, "sport.x", "b") for p in (1, 2, 3, 4, 100)
    ] + [("2024-01-01 10:00", "purchase", 1, "a", 5.0, 1, "auto.x", "b")])
    got = {r["top_category"]: r for r in anomaly.price_outlier_summary(ev).collect()}
    assert (got["sport"]["outlier_count"], got["sport"]["upper_fence"], got["sport"]["max_to_fence_ratio"]) == (1, 7.0, 14.3)
    assert (got["auto"]["outlier_count"], got["auto"]["outlier_pct"]) == (0, 0.0)
    assert [r["price"] for r in anomaly.price_outliers(ev).collect()] == [100.0]


def test_high_frequency_sessions(events):
    ev = events([
        ("2024-01-01 10:00", "view", 1, "bot", 1.0, p) for p in (1, 1, 2)
    ] + [("2024-01-01 11:30:59", "purchase", 1, "bot", 7.5, 3), ("2024-01-01 10:00", "view", 2, "human")])
    got = rows(anomaly.high_frequency_sessions(ev, 3))
    assert got == [(1, "bot", 4, 3, 2, 1, 7.5, date(2024, 1, 1), 90.0)]


def test_repeat_purchases_in_band(events):
    ev = events([
        ("2024-01-01", "purchase", 1, "a", 2574.0, 7), ("2024-01-04", "purchase", 1, "b", 2573.0, 7),
        ("2024-01-04", "purchase", 1, "b", 2575.01, 7), ("2024-01-01", "purchase", 2, "c", 2575.0, 7),
    ])
    assert rows(anomaly.repeat_cap_purchases(ev)) == [(1, 7, 2, date(2024, 1, 1), date(2024, 1, 4), 3, 2)]
    assert rows(anomaly.cap_concentration(ev)) == [(3, 2, 1.5)]
    assert rows(anomaly.cap_concentration(ev, 1, 2)) == [(0, 0, None)]


def test_session_spanning_both_periods_counts_in_both(events):
    ev = events([
        ("2024-01-10 23:00", "view", 1, "a"), ("2024-01-11 01:00", "purchase", 1, "a"),
        ("2024-01-12 01:00", "purchase", 1, "a"), ("2024-01-05 01:00", "purchase", 1, "excluded day"),
    ])
    got = {r["period"]: r for r in experiment.period_funnel(ev, SPEC).collect()}
    assert got["Pre-COVID"]["total_sessions"] == got["COVID onset"]["total_sessions"] == 1
    assert (got["Pre-COVID"]["purchase_sessions"], got["COVID onset"]["purchase_sessions"]) == (0, 1)
    assert [r["period"] for r in experiment.weekly_trend(ev, SPEC).collect()] == ["COVID onset", "Pre-COVID", "Transition"]


def test_buyer_can_be_new_and_returning(events):
    ev = events([
        ("2024-01-02", "purchase", 1, "a", 5.0), ("2024-01-03", "purchase", 1, "b", 7.0),
        ("2024-01-02", "purchase", 2, "c", 0.0), ("2024-01-13", "purchase", 2, "d", 3.0),
    ])
    assert rows(experiment.new_vs_returning(ev, SPEC)) == [
        ("Pre-COVID", "New buyer", 1, 1, 5.0, 5.0), ("Pre-COVID", "Returning buyer", 1, 1, 7.0, 7.0),
        ("COVID onset", "Returning buyer", 1, 1, 3.0, 3.0),
    ]


def test_published_ztest(spark):
    # Published session counts of the two periods.
    counts = spark.createDataFrame(
        [("Pre-COVID", 72_286_478, 4_218_364), ("COVID onset", 16_262_389, 1_119_942)],
        "period string, total_sessions long, purchase_sessions long",
    )
    test = experiment.two_proportion_ztest(counts).first()
    assert test["z_stat"] == pytest.approx(160.900, abs=5e-4) and test["p_value"] == 0.0
    effect = experiment.proportion_effect(counts).first()
    assert effect["cohens_h"] == pytest.approx(0.04310, abs=5e-6)
    assert effect["relative_change_pct"] == pytest.approx(18.01, abs=5e-3)
    assert effect["ci_low_pp"] < effect["delta_pp"] < effect["ci_high_pp"]
    assert experiment.two_proportion_ztest(counts, alternative="smaller").first()["p_value"] == 1.0


def test_split_weeks_are_merged(spark):
    weekly = spark.createDataFrame(
        [(date(2024, 1, 1), 100, 5), (date(2024, 1, 8), 40, 2), (date(2024, 1, 8), 60, 8)],
        "week_start date, weekly_sessions long, purchase_sessions long",
    )
    assert rows(experiment.weekly_conversion_merged(weekly)) == [
        (date(2024, 1, 1), 100, 5, 5.0, False), (date(2024, 1, 8), 100, 10, 10.0, True),
    ]


def test_features_use_first_events_and_earlier_purchases_only(events):
    ev = events([
        ("2024-01-01 09:00", "purchase", 1, "earlier", 9.0),
        ("2024-01-02 10:00", "view", 1, "s", 5.0, 1), ("2024-01-02 10:01", "purchase", 1, "s", 7.0, 2, "auto.x"),
        ("2024-01-02 10:02", "cart", 1, "s", 6.0, 1), ("2024-01-02 10:03", "view", 1, "s", 99.0, 3),
        ("2024-01-02 10:00", "view", 2, "short"), ("2024-01-02 10:01", "view", 2, "short"),
        ("2024-01-02 10:02", "purchase", 2, "short"),
    ])
    got = propensity.propensity_features(ev, 3, SPEC).collect()
    assert len(got) == 1  # sessions of three events have nothing left to predict
    row = got[0].asDict()
    assert row == {
        "user_session": "s", "products_viewed": 2, "categories_viewed": 2, "min_price_viewed": 5.0,
        "max_price_viewed": 7.0, "avg_price_viewed": 6.0, "cart_in_cutoff": 1, "session_start_hour": 10,
        "session_start_dow": 3, "is_returning_user": True, "prior_purchase_count": 1, "days_since_last_purchase": 1,
        "purchased_after_cutoff": False, "is_covid_period": False,
    }


def test_first_event_purchase_is_not_its_own_history(events):
    ev = events([("2024-01-02 10:00", "purchase", 1, "s")] + [("2024-01-02 10:01", "view", 1, "s")] * 3)
    row = propensity.propensity_features(ev, 3, SPEC).first()
    assert (row["prior_purchase_count"], row["is_returning_user"], row["days_since_last_purchase"]) == (0, False, None)


def test_small_column_helpers(spark):
    df = spark.createDataFrame([(4.38, 0.2, "samsung", -0.117)], "minutes double, r double, b string, c double")
    got = df.select(
        C.minutes_seconds(F.col("minutes")), C.tier_bucket(F.col("r")), C.capitalised(F.col("b")),
        C.signed_pct_text(F.col("c")), C.pct(F.lit(1), F.lit(3)), C.pct(F.lit(1), F.lit(0)),
    ).first()
    assert tuple(got) == ("4m 23s", "Low", "Samsung", "-11.7%", 33.33, None)
