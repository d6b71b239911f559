"""Plans and results when one key holds a third of all rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from clickloom.operators import anomaly, cohort, experiment, funnel, propensity, rfm, sessions
from clickloom.plans.catalog import SPEC
from clickloom.sources import fixture
from frames import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(events):
    """A third of the events belong to one user and one session, many at equal times; a third have no session."""
    random.seed(7)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        time = start + timedelta(minutes=random.randrange(20 * 24 * 60))
        kind = random.choice(["view", "view", "cart", "purchase"])
        if i % 3 == 0:
            user, session = 1, "hot"
        elif i % 3 == 1:
            user, session = random.randrange(2, 60), None
        else:
            user = random.randrange(2, 60)
            session = f"{user}-{time.day}"
        data.append((time, kind, user, session, round(random.uniform(0, 50), 2), random.randrange(30)))
    return events(data), data


def test_purchase_ranks_equal_brute_force(skewed):
    ev, data = skewed
    by_session = defaultdict(list)
    for i, (time, kind, _, session, *_rest) in enumerate(data):
        if session is not None:
            by_session[session].append((time, i, kind))
    want = sorted(
        (i, rank)
        for group in by_session.values()
        for rank, (_, i, kind) in enumerate(sorted(group), 1)
        if kind == "purchase"
    )
    assert sorted(rows(sessions.purchase_ranks(ev).select("event_id", "event_rank"))) == want


def test_a_session_inside_one_second_is_cut_further(events, monkeypatch):
    """All events of the hot session at one time: its slice is spread by id, and ranks are as if it were sorted whole."""
    second = datetime(2024, 1, 1, 12)
    draw = random.Random(5)
    data = [(second, draw.choice(["view", "cart", "purchase"]), 1, "hot", 1.0, 3) for _ in range(2000)]
    data += [(second + timedelta(seconds=i), "purchase", 2, "cold", 1.0, 3) for i in range(3)]
    used = []
    monkeypatch.setattr(sessions, "positions", lambda *a, f=sessions.positions: used.append(f(*a)) or used[-1])
    got = rows(sessions.purchase_ranks(events(data), slice_events=300).select("event_id", "event_rank"))
    want = [(i, i + 1 if i < 2000 else i - 1999) for i, row in enumerate(data) if row[1] == "purchase"]
    assert sorted(got) == want and len(used) == 1
    without_id = rows(sessions.purchase_ranks(events(data).drop("event_id"), slice_events=300).select("user_session", "event_rank"))
    counts = [sum(row[1] == kind for row in data[:2000]) for kind in ("view", "cart")]
    assert sorted(r for s, r in without_id if s == "hot") == list(range(sum(counts) + 1, 2001))


def test_sessionize_equals_brute_force(skewed):
    ev, data = skewed
    gap = timedelta(minutes=30)
    by_user = defaultdict(list)
    for i, (time, _, user, *_rest) in enumerate(data):
        by_user[user].append((time, i))
    want = {}
    for user, group in by_user.items():
        number, last = 0, None
        for time, i in sorted(group):
            if last is None or time - last > gap:
                number += 1
            want[i], last = f"{user}-{number}", time
    got = sessions.sessionize(ev.drop("user_session"), 1800)
    assert dict(rows(got.select("event_id", "user_session"))) == want


def test_history_equals_brute_force(skewed):
    ev, data = skewed
    spec = SPEC
    kept = [(t, i, k, u, s) for i, (t, k, u, s, *_r) in enumerate(data) if t.date() not in spec.excluded]
    by_session = defaultdict(list)
    for t, i, kind, user, session in kept:
        if session is not None:
            by_session[session].append((t, i, kind, user))
    want = {}
    for session, group in by_session.items():
        group.sort()
        t, i, _, user = group[0]
        if len(group) <= 3 or spec.pre_end < t.date() < spec.onset_start:
            continue
        before = [(bt, bi) for bt, bi, k, u, _ in kept if u == user and k == "purchase" and bt < t]
        days = (t.date() - max(before)[0].date()).days if before else None
        want[session] = (len(before), days, any(k == "purchase" for _, _, k, _ in group[3:]))
    got = propensity.propensity_features(ev, 3, spec).select(
        "user_session", "prior_purchase_count", "days_since_last_purchase", "purchased_after_cutoff"
    )
    assert {s: tuple(rest) for s, *rest in rows(got)} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_join_and_no_row_expansion(spark):
    full, timed = fixture.full_events(spark, FOLDER), fixture.session_events(spark, FOLDER)
    for df in (
        funnel.funnel_by_category(full), funnel.cart_abandonment(timed), sessions.session_summary(timed),
        sessions.depth_at_purchase(timed), experiment.period_funnel(timed, SPEC),
        experiment.period_session_behavior(timed, SPEC), experiment.weekly_trend(timed, SPEC),
        anomaly.high_frequency_sessions(timed, 10), anomaly.price_outlier_summary(full),
        cohort.cohort_matrix(fixture.order_events(spark, FOLDER)),
    ):
        plan = _plan(df)
        assert "Expand" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_first_events_are_limited_before_the_shuffle(spark):
    plan = _plan(propensity._first_events(fixture.full_events(spark, FOLDER), 3))
    after_exchange, before_exchange = plan.split("WindowGroupLimit", 1)[1].split("Exchange hashpartitioning", 1)
    assert "Final" in after_exchange and "WindowGroupLimit" in before_exchange and "Partial" in before_exchange


def test_scans_read_only_needed_columns(spark):
    plan = _plan(funnel.funnel_overall(fixture.session_events(spark, FOLDER)))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "value" not in plan and "PushedFilters: [In(event_type, [click,purchase,view])" in plan
    assert "p_brand" not in _plan(rfm.rfm_raw(fixture.base_events(spark, FOLDER)))
