"""The propensity model on made-up features with a known answer."""

import random

import pytest
from pyspark.ml import PipelineModel

from clickloom.operators import propensity as P
from frames import rows


@pytest.fixture(scope="module")
def features(spark):
    """Sessions with a cart buy in 9 of 10 cases, others in 1 of 20; the first half is for training."""
    random.seed(3)
    data = []
    for i in range(1200):
        cart = random.random() < 0.1
        label = random.random() < (0.9 if cart else 0.05)
        price = random.uniform(1, 100)
        since = random.randrange(30) if random.random() < 0.4 else None
        data.append((
            f"s{i}", random.randrange(1, 4), random.randrange(1, 3), price, price + 5, price + 2, int(cart),
            random.randrange(24), random.randrange(1, 8), since is not None, int(since is not None), since, label, i % 2 == 0,
        ))
    schema = (
        "user_session string, products_viewed long, categories_viewed long, min_price_viewed double, "
        "max_price_viewed double, avg_price_viewed double, cart_in_cutoff int, session_start_hour int, "
        "session_start_dow int, is_returning_user boolean, prior_purchase_count long, days_since_last_purchase int, "
        "purchased_after_cutoff boolean, is_covid_period boolean"
    )
    return spark.createDataFrame(data, schema).repartition(3)


def test_model_finds_the_signal_and_can_be_stored(spark, features, tmp_path):
    model = P.fit_propensity(features)
    holdout = features.where(P.HOLDOUT)
    scored = P.score_sessions(model, holdout)
    metrics = P.evaluate_propensity(scored).first()
    assert metrics["roc_auc"] > 0.8 and metrics["recall"] > 0.5 and metrics["precision"] > 0.6
    fit = P.newton(model, features)
    assert fit.step < 1e-9
    largest = P.coefficients(fit, features).first()
    assert largest["feature"] in ("cart_in_cutoff", "intercept") and abs(largest["weight"]) > 5 * largest["standard_error"] > 0
    close = dict(rows(P.score_sessions(model, holdout).select("user_session", "purchase_prob")))
    exact = dict(rows(P.score_sessions(model, holdout, fit).select("user_session", "purchase_prob")))
    assert max(abs(close[s] - exact[s]) for s in exact) < 1e-3
    model.save(str(tmp_path / "model"))
    again = P.score_sessions(PipelineModel.load(str(tmp_path / "model")), holdout)
    assert sorted(rows(again)) == sorted(rows(scored))


def test_reports_add_up(spark, features):
    scored = P.score_sessions(P.fit_propensity(features), features.where(P.HOLDOUT))
    n, bought = scored.count(), scored.where(f"{P.LABEL} = 1").count()
    lift = P.decile_lift(scored).collect()
    assert [r["score_decile"] for r in lift] == list(range(1, 11))
    assert sum(r["sessions_in_decile"] for r in lift) == n and sum(r["purchases_in_decile"] for r in lift) == bought
    assert lift[0]["avg_predicted_prob_pct"] >= lift[-1]["avg_predicted_prob_pct"]
    assert sum(r["sessions"] for r in P.calibration(scored).collect()) == n
    curve = P.roc_curve(scored).collect()
    assert (curve[-1]["recall"], curve[-1]["false_positive_rate"]) == (1.0, 1.0)
    assert [r["recall"] for r in curve] == sorted(r["recall"] for r in curve)


def test_area_of_crowded_scores(spark):
    """Scores that differ in the sixth digit only, some equal: the area is that of all pairs."""
    draw = random.Random(8)
    data = [(f"s{i}", int(draw.random() < 0.3), 0.5 + draw.randrange(400) * 1e-6) for i in range(900)]
    scored = spark.createDataFrame(data, f"user_session string, {P.LABEL} int, purchase_prob double")
    yes, no = ([p for _, y, p in data if y == k] for k in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
    for bound in (10**6, 50):
        assert P.roc_area(scored, bound).first()["area"] == pytest.approx(want, abs=1e-12)
    assert P.roc_area(scored.where(f"{P.LABEL} = 1")).first()["area"] is None
