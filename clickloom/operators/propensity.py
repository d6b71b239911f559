"""How likely is a session to end in a purchase, judged by its first events?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.functions import columns as C
from clickloom.functions import vocab
from clickloom.functions.periods import PeriodSpec
from clickloom.functions.ranges import RANGE_ROWS, in_ranges
from clickloom.operators.ranking import Score, add_ntiles
from clickloom.operators.sessions import SLICE_SECONDS
from clickloom.sources.stable import written

DEFAULT = PeriodSpec()

FEATURES = [
    "products_viewed",
    "categories_viewed",
    "min_price_viewed",
    "max_price_viewed",
    "avg_price_viewed",
    "cart_in_cutoff",
    "session_start_hour",
    "session_start_dow",
    "is_returning_user",
    "prior_purchase_count",
    "days_since_last_purchase",
]
LABEL = "purchased_after_cutoff"
HOLDOUT = "is_covid_period"


def _first_events(ev: DataFrame, cutoff: int) -> DataFrame:
    """One row per session from its first ``cutoff`` events.

    The rank filter makes Spark keep only that many events per session on the
    map side, so even an endless session moves next to nothing.
    """
    rank = F.row_number().over(W.partitionBy("user_session").orderBy(*C.tie_order(ev)))
    first = (
        ev.withColumn("_category", C.top_category())
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= cutoff)
    )

    def at(position: int, column: str) -> Column:
        return F.max(F.when(F.col("_rank") == position, F.col(column)))

    def distinct(column: str) -> Column:
        values = F.array(*[at(i, column) for i in range(1, cutoff + 1)])
        return F.size(F.array_distinct(F.array_compact(values))).cast("long")

    return first.groupBy("user_session").agg(
        at(1, "user_id").alias("user_id"),
        at(1, "event_time").alias("session_start"),
        distinct("product_id").alias("products_viewed"),
        distinct("_category").alias("categories_viewed"),
        F.min("price").alias("min_price_viewed"),
        F.max("price").alias("max_price_viewed"),
        C.exact_mean(F.col("price")).alias("avg_price_viewed"),
        C.has_type(vocab.CART).alias("cart_in_cutoff"),
        F.hour(at(1, "event_time")).alias("session_start_hour"),
        F.dayofweek(at(1, "event_time")).alias("session_start_dow"),
        C.count_type(vocab.PURCHASE).alias("_early_purchases"),
    )


def _with_history(sessions: DataFrame, purchases: DataFrame) -> DataFrame:
    """Add the user's purchases strictly before each session's first event.

    Purchases are first counted per (user, time). Openings and these counts form one stream per user. Sums over
    earlier time slices (a window over one row per slice) plus a running sum over earlier times inside the slice give
    the history, so a user with very many purchases is spread out, and any number of purchases at one time is one row.
    """
    bought = purchases.groupBy("user_id", F.unix_micros("event_time").alias("_micros")).agg(
        F.count("*").alias("_bought"), F.max("event_time").alias("_bought_at")
    )
    opened = sessions.withColumn("_micros", F.unix_micros("session_start"))
    stream = opened.unionByName(bought, allowMissingColumns=True)
    stream = stream.withColumn("_slice", F.floor(F.col("_micros") / (SLICE_SECONDS * 1_000_000)))
    slices = stream.groupBy("user_id", "_slice").agg(F.sum("_bought").alias("_n"), F.max("_bought_at").alias("_last"))
    earlier = W.partitionBy("user_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select(
        "user_id",
        "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
        F.max("_last").over(earlier).alias("_last_before"),
    )
    before = W.partitionBy("user_id", "_slice").orderBy("_micros").rangeBetween(W.unboundedPreceding, -1)
    counted = stream.join(carried, ["user_id", "_slice"]).select(
        *sessions.columns,
        "_bought",
        (F.col("_n_before") + F.coalesce(F.sum("_bought").over(before), F.lit(0))).alias("prior_purchase_count"),
        F.coalesce(F.max("_bought_at").over(before), F.col("_last_before")).alias("_last_purchase"),
    )
    return counted.where(F.col("_bought").isNull())


def propensity_features(ev: DataFrame, cutoff: int = 3, spec: PeriodSpec = DEFAULT) -> DataFrame:
    """Features from the first events, label from the later ones, history from strictly before the session.

    Runs a Spark job when called: the openings of all sessions are written.
    """
    kept = ev.where(spec.kept(C.day(ev)))
    named = kept.where(F.col("user_session").isNotNull())
    totals = named.groupBy("user_session").agg(
        F.count("*").alias("_length"), C.count_type(vocab.PURCHASE).alias("_purchases")
    )
    period = F.when(F.to_date("session_start") <= F.lit(spec.pre_end), False).when(
        F.to_date("session_start") >= F.lit(spec.onset_start), True
    )
    sessions = (
        _first_events(named, cutoff)
        .withColumn(HOLDOUT, period)
        .where(F.col(HOLDOUT).isNotNull())
        .join(totals.where(F.col("_length") > cutoff), "user_session")
        .withColumn(LABEL, F.col("_purchases") > F.col("_early_purchases"))
        .drop("_early_purchases", "_purchases", "_length")
    )
    purchases = kept.where(C.is_type(vocab.PURCHASE)).select("user_id", "event_time")
    # Read twice below; written so that the first events of all sessions are looked up only once.
    history = _with_history(written(sessions, "session-openings"), purchases)
    return history.select(
        "user_session",
        *FEATURES[:8],
        (F.col("prior_purchase_count") > 0).alias("is_returning_user"),
        "prior_purchase_count",
        F.date_diff(F.to_date("session_start"), F.to_date("_last_purchase")).alias("days_since_last_purchase"),
        LABEL,
        HOLDOUT,
    )


def _as_numbers(features: DataFrame) -> DataFrame:
    numbers = {c: F.col(c).cast("double") for c in FEATURES}
    return features.withColumns({**numbers, "label": F.col(LABEL).cast("double")})


def _class_weight(train: DataFrame) -> Column:
    """Weight of a training row by its label, so that both classes count the same."""
    sizes = train.agg(F.count("*").alias("n"), F.sum("label").alias("positive")).first()
    rows, positive = sizes["n"], sizes["positive"] or 0.0
    return F.when(F.col("label") == 1.0, rows / (2.0 * max(positive, 1.0))).otherwise(
        rows / (2.0 * max(rows - positive, 1.0))
    )


def fit_propensity(features: DataFrame, max_iter: int = 200, holdout: str = HOLDOUT) -> PipelineModel:
    """Logistic regression on the pre period; classes are weighted so that both count the same.

    Missing values take the feature's mean (0 where no session has the feature) and features are standardised. Raises
    if ``max_iter`` steps do not reach the optimum. Training passes over the features many
    times: give it a stored table. The returned model is saved with ``model.save(path)``.
    """
    train = _as_numbers(features.where(~F.col(holdout)))
    weight = _class_weight(train)
    means = train.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in FEATURES]).first()
    filled = [f"coalesce({c}, cast('{means[c]!r}' AS double)) AS {c}_filled" for c in FEATURES]
    pipeline = Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_filled" for c in FEATURES], outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, tol=1e-9),
    ])
    model = pipeline.fit(train.withColumn("weight", weight))
    if model.stages[-1].summary.totalIterations >= max_iter:
        raise RuntimeError(f"training has not converged after {max_iter} steps")
    return model


def fit_residuals(model: PipelineModel, features: DataFrame, holdout: str = HOLDOUT, digits: int = 3) -> DataFrame:
    """How far the fit is from its optimum: per standardised feature, and for the intercept, the weighted mean of
    (predicted - actual) * feature over the training sessions. All are 0 at the optimum. Runs a Spark job."""
    train = _as_numbers(features.where(~F.col(holdout)))
    scored, weight = model.transform(train), _class_weight(train)
    error = weight * (vector_to_array("probability")[1] - F.col("label"))
    values = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    means = scored.select(error.alias("_error"), weight.alias("_weight"), values.alias("_x")).agg(
        F.array(*[F.sum(F.col("_error") * F.col("_x")[i]) / F.sum("_weight") for i in range(len(FEATURES) + 1)]).alias("_mean")
    )
    names = F.array(*map(F.lit, [*FEATURES, "intercept"]))
    return means.select(F.explode(F.arrays_zip(names.alias("feature"), F.col("_mean").alias("residual"))).alias("_r")).select(
        F.col("_r")["feature"].alias("feature"), F.abs(F.round(F.col("_r")["residual"], digits)).alias("residual")
    )


@dataclass(frozen=True)
class Fit:
    """Weights of the standardised features and of the intercept (last), their standard errors, and the last Newton step."""

    weights: list[float]
    standard_errors: list[float]
    step: float


def _design() -> Column:
    """Standardised features and a one for the intercept, of rows that the model has transformed."""
    return F.concat(vector_to_array("features"), F.array(F.lit(1.0)))


def _probability(x: Column, weights: Sequence[float]) -> Column:
    return 1 / (1 + F.exp(-sum((x[i] * w for i, w in enumerate(weights)), F.lit(0.0))))


def newton(model: PipelineModel, features: DataFrame, holdout: str = HOLDOUT, steps: int = 6, settled: float = 1e-13) -> Fit:
    """Carry the fit to its optimum by Newton steps; the last step bounds what is left of the error.

    Gradient and information matrix are sums of outer products over the training sessions, one distributed aggregate for each
    step, of which the driver gets one row. The standard errors are those of the weighted likelihood. Where
    classes are separable there is no optimum, and the step stays large. Runs Spark jobs.
    """
    train = _as_numbers(features.where(~F.col(holdout)))
    base = model.transform(train).select(_design().alias("_x"), _class_weight(train).alias("_weight"), "label")
    base = written(base, "standardised")
    n, x, w = len(FEATURES) + 1, F.col("_x"), F.col("_weight")
    weights = np.append(np.array(model.stages[-1].coefficients), model.stages[-1].intercept)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    for _ in range(steps):
        p = _probability(x, weights.tolist())
        rows = base.select(x, (w * (F.col("label") - p)).alias("_g"), (w * p * (1 - p)).alias("_h"))
        sums = rows.agg(
            F.array(*[F.sum(F.col("_g") * x[i]) for i in range(n)]).alias("g"),
            F.array(*[F.sum(F.col("_h") * x[i] * x[j]) for i, j in pairs]).alias("h"),
        ).first()
        information = np.zeros((n, n))
        for (i, j), value in zip(pairs, sums["h"]):
            information[i, j] = information[j, i] = value
        step = np.linalg.lstsq(information, np.array(sums["g"]), rcond=None)[0]  # a constant feature has weight 0
        weights = weights + step
        if np.abs(step).max() < settled:
            break
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(information)), 0))
    return Fit(weights.tolist(), errors.tolist(), float(np.abs(step).max()))


def score_sessions(model: PipelineModel, features: DataFrame, fit: Fit | None = None) -> DataFrame:
    """One row per session: label and predicted probability of a purchase, by the weights of ``fit`` if there is one."""
    scored = model.transform(_as_numbers(features))
    return scored.select(
        "user_session",
        F.col("label").cast("int").alias(LABEL),
        (vector_to_array("probability")[1] if fit is None else _probability(_design(), fit.weights)).alias("purchase_prob"),
    )


def roc_area(scored: DataFrame, bound: int = RANGE_ROWS) -> DataFrame:
    """One row: the exact area under the ROC curve (share of pairs in the right order, ties half); NULL for one class.

    Labels are counted per score. The negatives below each score are a running sum, over ranges of scores of ``bound``
    different ones at most, however the scores are distributed. Runs Spark jobs when called.
    """
    by_score = scored.groupBy("purchase_prob").agg(F.sum(LABEL).alias("pos"), F.sum(1 - F.col(LABEL)).alias("neg"))
    by_score = written(by_score, "score-counts")
    cut = in_ranges(by_score, ["purchase_prob"], by_score.count(), bound)
    ranges = cut.groupBy("_range").agg(F.sum("neg").alias("_neg"))
    below = ranges.select("_range", (F.sum("_neg").over(W.orderBy("_range")) - F.col("_neg")).alias("_below"))
    inside = W.partitionBy("_range").orderBy("purchase_prob")
    rank = F.col("_below") + F.sum("neg").over(inside) - F.col("neg") / 2
    won = cut.join(below, "_range").withColumn("_won", F.col("pos") * rank)
    return won.agg(C.ratio(F.sum("_won"), F.sum("pos") * F.sum("neg")).alias("area"))


def evaluate_propensity(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, accuracy, F1, log loss and area under the ROC curve in one row."""
    said, real = F.col("purchase_prob") >= threshold, F.col(LABEL) == 1
    prob = F.greatest(F.least(F.col("purchase_prob"), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.when(real, F.log(prob)).otherwise(F.log(1 - prob))
    counts = scored.agg(
        F.count_if(said & real).alias("tp"),
        F.count_if(said & ~real).alias("fp"),
        F.count_if(~said & real).alias("fn"),
        F.count("*").alias("n"),
        F.avg(loss).alias("log_loss"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    both = counts.withColumn("_one", F.lit(1)).join(roc_area(scored).withColumn("_one", F.lit(1)), "_one")  # one row each
    return both.select(
        C.ratio(tp, tp + fp, 6).alias("precision"),
        C.ratio(tp, tp + fn, 6).alias("recall"),
        C.ratio(F.col("n") - fp - fn, F.col("n"), 6).alias("accuracy"),
        C.ratio(2 * tp, 2 * tp + fp + fn, 6).alias("f1_score"),
        F.round("log_loss", 6).alias("log_loss"),
        F.round("area", 6).alias("roc_auc"),
    )


def roc_curve(scored: DataFrame, thresholds: int = 100) -> DataFrame:
    """Recall and false positive rate at evenly spaced thresholds, from 0 to 1.

    Scores are counted per threshold step first; the running sums then work on ``thresholds`` + 1 rows. A score equal to
    a threshold reaches it: the step found by multiplication is checked against the thresholds beside it.
    """
    prob, near = F.col("purchase_prob"), F.floor(F.col("purchase_prob") * thresholds)
    exact = F.when((near + 1) / thresholds <= prob, near + 1).when(near / thresholds > prob, near - 1).otherwise(near)
    counted = scored.groupBy(exact.cast("long").alias("step")).agg(
        F.sum(LABEL).alias("positives"), F.sum(1 - F.col(LABEL)).alias("negatives")
    )
    steps = scored.sparkSession.range(thresholds + 1).withColumnRenamed("id", "step").join(counted, "step", "left")
    steps = steps.fillna(0, ["positives", "negatives"])
    from_top = W.orderBy(F.desc("step"))
    everything = W.partitionBy()
    return (
        steps.select(
            (F.col("step") / thresholds).alias("threshold"),
            F.sum("positives").over(from_top).alias("true_positives"),
            F.sum("negatives").over(from_top).alias("false_positives"),
            F.sum("positives").over(everything).alias("_p"),
            F.sum("negatives").over(everything).alias("_n"),
        )
        .select(
            "threshold",
            C.ratio(F.col("true_positives"), F.col("_p"), 6).alias("recall"),
            C.ratio(F.col("false_positives"), F.col("_n"), 6).alias("false_positive_rate"),
            "true_positives",
            "false_positives",
        )
        .orderBy(F.desc("threshold"))
    )


def decile_lift(scored: DataFrame, tiles: int = 10) -> DataFrame:
    """Share of all purchases found in each tenth of the sessions, best scores first. Runs Spark jobs when called."""
    ranked = add_ntiles(scored, [Score("score_decile", -F.col("purchase_prob"))], "user_session", tiles)
    by_tile = ranked.groupBy("score_decile").agg(
        F.count("*").alias("sessions_in_decile"),
        F.sum(LABEL).alias("purchases_in_decile"),
        F.avg("purchase_prob").alias("_prob"),
    )
    bought = F.col("purchases_in_decile")
    return by_tile.select(
        "score_decile",
        "sessions_in_decile",
        "purchases_in_decile",
        C.pct(bought, F.sum(bought).over(W.partitionBy())).alias("pct_of_all_purchases_captured"),
        C.pct(bought, F.col("sessions_in_decile")).alias("purchase_rate_in_decile_pct"),
        F.round(F.col("_prob") * 100.0, 2).alias("avg_predicted_prob_pct"),
    ).orderBy("score_decile")


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Predicted against actual purchase rate per probability bin."""
    number = F.least(F.floor(F.col("purchase_prob") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return (
        scored.groupBy(number)
        .agg(
            F.count("*").alias("sessions"),
            F.round(F.avg("purchase_prob"), 6).alias("avg_predicted"),
            C.ratio(F.sum(LABEL), F.count("*"), 6).alias("actual_rate"),
        )
        .orderBy("bin")
    )


def coefficients(fit: Fit, like: DataFrame) -> DataFrame:
    """Weight and standard error per standardised feature, and of the intercept."""
    rows = list(zip([*FEATURES, "intercept"], fit.weights, fit.standard_errors))
    return like.sparkSession.createDataFrame(rows, "feature string, weight double, standard_error double").orderBy(F.desc(F.abs("weight")))
