"""Classifiers and their evaluation.

Every model is fitted by Spark jobs over one packed table (``fitting``): forest,
logistic regression, boosted trees and net by sums over tasks, the support vector
classifier by MLlib's hinge models.  A fitted model is a few numbers (``Fitted``),
saved as JSON.  Predictions are the long prediction table the metric operators
read (model, split, y_true, y_pred, p_H, p_D, p_A).  Gaussian naive Bayes is
native DataFrame code: class statistics are one grouped aggregation (k x p
values), applied to rows as literals.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.operators import boosting, forest, logistic, net, svm
from pitchline.operators.fitting import Fitted, Packed, pack, softmax
from pitchline.operators.prep import q
from pitchline.operators.splits import before_cut
from pitchline.session import scratch_path

LABEL = "target_match_result"
CLASSES = ["A", "D", "H"]          # alphabetical index order (label encoder)
SCALED_MODELS = {"svm", "fnn", "logistic_regression", "naive_bayes"}

# Model parameters of the reference configuration.
MODEL_PARAMS = {
    "random_forest": {"n_estimators": 100, "max_depth": 4, "min_samples_split": 30, "min_samples_leaf": 15,
                      "max_features": "sqrt", "random_state": 42, "class_weight": "balanced"},
    "logistic_regression": {"C": 0.01, "random_state": 42, "class_weight": "balanced", "solver": "lbfgs",
                            "max_iter": 1000, "penalty": "l2"},
    "xgboost": {"n_estimators": 100, "max_depth": 2, "learning_rate": 0.03, "subsample": 0.6,
                "colsample_bytree": 0.5, "reg_lambda": 10.0, "reg_alpha": 2.0, "random_state": 42},
    "naive_bayes": {"var_smoothing": 1e-06},
    "svm": {"C": 0.1, "kernel": "linear", "probability": True, "random_state": 42, "class_weight": "balanced"},
    "fnn": {"hidden_layer_sizes": (16,), "activation": "relu", "learning_rate_init": 0.001, "max_iter": 200,
            "random_state": 42, "early_stopping": True, "validation_fraction": 0.1, "alpha": 0.1},
}
MODEL_TYPES = list(MODEL_PARAMS)


def time_columns(df: DataFrame) -> list[str]:
    """The columns that order rows in time, as far as there are any."""
    when = [c for c in ("kickoff", "date_GMT", "timestamp") if c in df.columns][:1]
    return when + [c for c in ("match_id",) if when and c in df.columns]


def _last_tenth(data: Packed, order: list[str], share: float) -> F.Column:
    """Condition of the packed rows that come last in time; without a time a
    share of the rows by hash."""
    keys = [f"o{i}" for i in range(len(order))]
    if not keys:
        return F.pmod(F.xxhash64("id"), F.lit(1000)) < int(1000 * share)
    return ~before_cut(data.rows, keys, 1 - share)


def fit(train: DataFrame, features: list[str], model_type: str, params: dict | None = None) -> Fitted:
    """M1-M3: pack the labelled rows (labels in alphabetical order, features
    scaled where the model wants it) and fit."""
    if model_type not in MODEL_TYPES or model_type == "naive_bayes":
        raise ValueError(f"unknown model type {model_type!r}; supported: {MODEL_TYPES}")
    p = {**MODEL_PARAMS[model_type], **(params or {})}
    balanced = p.pop("class_weight", None) == "balanced"
    order = time_columns(train) if model_type == "fnn" else []
    data = pack(train, features, LABEL, model_type in SCALED_MODELS, balanced, order=order)
    try:
        if model_type == "random_forest":
            return forest.fit_forest(data, **p)
        if model_type == "logistic_regression":
            return logistic.fit_logistic(data, p["C"], p["max_iter"])
        if model_type == "xgboost":
            return boosting.fit_boosted(data, **p)
        if model_type == "svm":
            return svm.fit_svm(data, p["C"])
        return net.fit_net(data, _last_tenth(data, order, p.pop("validation_fraction")), **{k: v for k, v in p.items() if k != "activation"})
    finally:
        data.close()


def _scores(model: Fitted, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class index, class probabilities) of feature rows."""
    if model.kind == "svm":
        return svm.scores(model, x)
    if model.kind == "random_forest":
        prob = forest.distribution(model, x)
    elif model.kind == "xgboost":
        prob = softmax(boosting.margins_of(model, x))
    else:
        prob = net.probabilities(model, x)
    return prob.argmax(axis=1), prob


def predict(model: Fitted, df: DataFrame, keep=("match_id",)) -> DataFrame:
    """(keep..., y_pred, p_H, p_D, p_A); a class that training did not see has
    probability 0."""
    if model.kind == "logistic_regression":
        s = df.select(*[q(c) for c in keep], logistic.probabilities(model).alias("_prob"))
        s = s.withColumn("_pred", F.array_position("_prob", F.array_max("_prob")) - 1)
    else:
        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(x: pd.Series) -> pd.Series:
            pred, prob = _scores(model, np.stack(x.to_numpy()).astype(float)) if len(x) else (np.zeros(0), np.zeros((0, 1)))
            return pd.Series(list(np.column_stack([pred, prob])))

        s = df.select(*[q(c) for c in keep], score(model.inputs()).alias("_s"))
        s = s.select(*[q(c) for c in keep], F.slice("_s", 2, len(model.classes)).alias("_prob"), F.get("_s", F.lit(0)).alias("_pred"))
    prob = {c: F.get("_prob", F.lit(i)) for i, c in enumerate(model.classes)}
    label = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("_pred").cast("int") + 1)
    return s.select(*[q(c) for c in keep], label.alias("y_pred"), *[prob.get(c, F.lit(0.0)).alias(f"p_{c}") for c in ("H", "D", "A")])


def feature_importance(model: Fitted, features: list[str] | None = None) -> dict[str, float] | None:
    """Tree importances, mean |coefficient| of the linear models, else None."""
    kinds = {"random_forest": forest, "xgboost": boosting, "logistic_regression": logistic, "svm": svm}
    return kinds[model.kind].importance(model) if model.kind in kinds else None


def importance_frame(spark, model_type: str, imp: dict | None) -> DataFrame:
    rows = [(model_type, k, float(v)) for k, v in (imp or {}).items()]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def model_info(model_type: str, features: list[str], params: dict | None = None) -> dict:
    """M14."""
    return {"model_type": model_type, "params": json.dumps({**MODEL_PARAMS.get(model_type, {}), **(params or {})},
                                                           default=str),
            "n_features": len(features), "feature_names": features,
            "uses_scaler": model_type in SCALED_MODELS}


def save_model(spark, model: Fitted, path: str) -> str:
    """The model with its scaling, classes and feature names, as one JSON text."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_model(spark, path: str) -> Fitted:
    return Fitted.from_json(spark.read.option("wholetext", True).text(path).head()[0])


# ------------------------------------------------------------------ M8 native Gaussian NB
def scaler(train: DataFrame, features: list[str]):
    """The scaling of ``train`` (mean, population deviation; 0 counts as 1) as a
    function (df, keep) -> scaled df.  Its 2 p numbers come to the driver, as
    those of any fitted model; the pipelines of the other scaled models hold
    the same step."""
    r = train.agg(*[f(q(c)).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
    center = [r[f"m{i}"] for i in range(len(features))]
    scale = [r[f"s{i}"] or 1.0 for i in range(len(features))]

    def scaled(df: DataFrame, keep=("match_id", LABEL)) -> DataFrame:
        return df.select(*[q(k) for k in keep], *[((q(c) - F.lit(m)) / F.lit(s)).alias(c) for c, m, s in zip(features, center, scale)])

    return scaled


def gaussian_nb_fit(train: DataFrame, features: list[str], var_smoothing: float = 1e-6) -> DataFrame:
    """One row per class: prior, means and smoothed variances (k x p values)."""
    n = F.count(F.lit(1))
    stats = train.where(F.col(LABEL).isNotNull()).groupBy(LABEL).agg(
        n.alias("n_c"), *[F.avg(q(c)).alias(f"mu{i}") for i, c in enumerate(features)],
        *[F.var_pop(q(c)).alias(f"var{i}") for i, c in enumerate(features)])
    largest = train.agg(*[F.var_pop(q(c)) for c in features]).head()
    eps = F.lit(max(v or 0.0 for v in largest) * var_smoothing)
    tot = stats.select(F.sum("n_c")).scalar()
    return stats.select(LABEL, (F.col("n_c") / tot).alias("prior"),
                        *[F.col(f"mu{i}") for i in range(len(features))],
                        *[(F.col(f"var{i}") + eps).alias(f"var{i}") for i in range(len(features))])


def gaussian_nb_params(stats: DataFrame) -> dict:
    """The fitted model: k rows of 2p+1 numbers (bounded by classes x
    features, never by rows), brought to the driver like any MLlib model."""
    return {r[LABEL]: r.asDict() for r in stats.collect()}


def gaussian_nb_predict(df: DataFrame, stats, features: list[str], keep=("match_id",)) -> DataFrame:
    """Joint log-likelihood per class, argmax (first of A, D, H wins ties, as
    numpy's argmax) and softmax probabilities; model values are literals so
    the scoring is one codegen'd projection."""
    import math
    params = stats if isinstance(stats, dict) else gaussian_nb_params(stats)
    per = {}
    for c in CLASSES:
        if c not in params:
            per[c] = F.lit(float("-inf"))
            continue
        row = params[c]
        ll = F.lit(math.log(row["prior"]))
        for i, f in enumerate(features):
            mu, var = F.lit(row[f"mu{i}"]), F.lit(row[f"var{i}"])
            ll = ll - F.lit(0.5 * math.log(2 * math.pi)) - 0.5 * F.ln(var) - (q(f) - mu) * (q(f) - mu) / (2 * var)
        per[c] = ll
    s = df.select(*keep, *[per[c].alias(f"ll_{c}") for c in CLASSES])
    mx = F.greatest(*[F.col(f"ll_{c}") for c in CLASSES])
    ex = {c: F.exp(F.col(f"ll_{c}") - mx) for c in CLASSES}
    tot = ex["A"] + ex["D"] + ex["H"]
    # argmax with the first class (A, D, H order) winning ties, as numpy does
    best = (F.when((F.col("ll_A") >= F.col("ll_D")) & (F.col("ll_A") >= F.col("ll_H")), "A")
             .when(F.col("ll_D") >= F.col("ll_H"), "D").otherwise("H"))
    return s.select(*keep, best.alias("y_pred"), (ex["H"] / tot).alias("p_H"), (ex["D"] / tot).alias("p_D"),
                    (ex["A"] / tot).alias("p_A"))


# ------------------------------------------------------------------ E1
STATUS = "model string, stage string, message string"


def _fit_scorer(train: DataFrame, features, model_type, params, keep):
    """Fit one model: (function that scores a frame, importances)."""
    own = (*keep, LABEL)
    if model_type == "naive_bayes":
        scaled = scaler(train, features)
        stats = gaussian_nb_params(gaussian_nb_fit(scaled(train, own), features, {**MODEL_PARAMS[model_type], **(params or {})}["var_smoothing"]))
        score, imp = (lambda d: gaussian_nb_predict(scaled(d, own), stats, features, own)), None
    else:
        model = fit(train, features, model_type, params)
        score, imp = (lambda d: predict(model, d, own)), feature_importance(model)
    return score, imp


def compare_models(train: DataFrame, splits: dict[str, DataFrame], features: list[str],
                   model_types=MODEL_TYPES, keep=("match_id",), params: dict[str, dict] | None = None):
    """Train each model on ``train`` and predict every split.

    Returns (long prediction table, importances, status).  Predictions are
    written model by model and split by split, so that an error shows where it
    happens.  ``status`` has one row per model (model, stage, message): stage
    ``done``, or ``fit`` or ``predict <split>`` with the error that ended it; the
    predictions that a failed model had made before are left out."""
    spark = train.sparkSession
    preds, imps, status = None, None, []
    for order, mt in enumerate(model_types):
        stage, parts = "fit", None
        try:
            score, imp = _fit_scorer(train, features, mt, (params or {}).get(mt), keep)
            for s, d in splits.items():
                stage, path = f"predict {s}", scratch_path(spark, f"predictions-{mt}")
                score(d).withColumn("split", F.lit(s)).write.parquet(path)
                one = spark.read.parquet(path)
                parts = one if parts is None else parts.unionByName(one)
        except Exception as e:  # noqa: BLE001 - a failed model is a row of the result
            status.append((mt, stage, f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"))
            continue
        status.append((mt, "done", None))
        p = parts.select(F.lit(mt).alias("model"), F.lit(order).alias("model_ord"), "split", *keep,
                         F.col(LABEL).alias("y_true"), "y_pred", "p_H", "p_D", "p_A")
        preds = p if preds is None else preds.unionByName(p)
        if imp:
            f = importance_frame(spark, mt, imp)
            imps = f if imps is None else imps.unionByName(f)
    return preds, imps, spark.createDataFrame(status, STATUS)


# ------------------------------------------------------------------ M13
def param_grid(grid: dict) -> list[dict]:
    """Cartesian product of a {param: [values]} grid (as ParamGridBuilder)."""
    import itertools
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def grid_search(folds: DataFrame, features: list[str], model_type: str, grid: dict, n_splits: int,
                metric: str = "f1_macro") -> DataFrame:
    """Every parameter combination trained on each walk-forward fold's
    training rows and scored on its validation rows (``walk_forward``
    output); one row per combination with the mean score.  Each fit is a
    distributed job; the loop runs over combinations x folds only."""
    from pitchline.operators.metrics import classification_metrics
    from pitchline.operators.splits import fold_rows
    spark = folds.sparkSession
    rows = []
    for params in param_grid(grid):
        scores = []
        for i in range(n_splits):
            tr, va = fold_rows(folds, i)
            if model_type == "naive_bayes":
                scaled = scaler(tr, features)
                st = gaussian_nb_params(gaussian_nb_fit(scaled(tr), features, params.get("var_smoothing", 1e-6)))
                p = gaussian_nb_predict(scaled(va), st, features, ("match_id", LABEL))
            else:
                p = predict(fit(tr, features, model_type, params), va, ("match_id", LABEL))
            p = p.select(F.lit(model_type).alias("model"), F.lit(f"fold{i}").alias("split"),
                         F.col(LABEL).alias("y_true"), "y_pred", "p_H", "p_D", "p_A")
            scores.append(classification_metrics(p).select(metric).collect()[0][0])
        rows.append((model_type, json.dumps(params, sort_keys=True), float(sum(scores) / len(scores)), len(scores)))
    return spark.createDataFrame(rows, f"model string, params string, mean_{metric} double, folds int")
