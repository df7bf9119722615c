"""Model properties: probabilities sum to 1, labels within {H, D, A}, better
than the majority class on a separable fixture, persistence round trip."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

FEATURES = ["f1", "f2"]


@pytest.fixture(scope="module")
def separable(spark):
    # three well separated classes derived from a range: deterministic
    df = spark.range(600).select(
        F.col("id").alias("match_id"),
        F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), (F.col("id") % 3 + 1).cast("int"))
        .alias("target_match_result"),
        ((F.col("id") % 3) * 5.0 + F.sin(F.col("id"))).alias("f1"),
        ((F.col("id") % 3) * -3.0 + F.cos(F.col("id"))).alias("f2"))
    return df


@pytest.mark.parametrize("model_type", ["random_forest", "logistic_regression", "svm"])
def test_model_properties(spark, separable, model_type):
    from pitchline.operators.models import fit, predict
    m = fit(separable, FEATURES, model_type)
    p = predict(m, separable, ("match_id", "target_match_result")).toPandas()
    assert set(p.y_pred) <= {"H", "D", "A"}
    assert ((p.p_H + p.p_D + p.p_A - 1).abs() < 1e-9).all()
    assert (p.y_pred == p.target_match_result).mean() > 0.9


def test_gaussian_nb(spark, separable):
    from pitchline.operators.models import gaussian_nb_fit, gaussian_nb_predict
    st = gaussian_nb_fit(separable, FEATURES)
    p = gaussian_nb_predict(separable, st, FEATURES, ("match_id", "target_match_result")).toPandas()
    assert ((p.p_H + p.p_D + p.p_A - 1).abs() < 1e-9).all()
    assert (p.y_pred == p.target_match_result).mean() > 0.9


def test_roundtrip(spark, separable):
    from pitchline.operators.models import fit, load_model, predict, save_model
    from pitchline.session import scratch_path
    m = fit(separable, FEATURES, "logistic_regression")
    m2 = load_model(spark, save_model(spark, m, scratch_path(spark, "m")))
    a = predict(m, separable).orderBy("match_id").toPandas()
    b = predict(m2, separable).orderBy("match_id").toPandas()
    assert a.equals(b)


def test_failed_models_are_rows(spark, separable):
    from pitchline.operators.models import compare_models
    broken = separable.withColumn("f1", F.raise_error(F.lit("planted")).cast("double"))
    preds, _, status = compare_models(separable, {"test": separable, "bad": broken}, FEATURES, ["naive_bayes", "no_such_model"])
    rows = {r["model"]: (r["stage"], r["message"]) for r in status.collect()}
    assert preds is None
    assert rows["naive_bayes"][0] == "predict bad" and rows["naive_bayes"][1]
    assert rows["no_such_model"][0] == "fit" and "no_such_model" in rows["no_such_model"][1]
    preds, _, status = compare_models(separable, {"test": separable}, FEATURES, ["naive_bayes", "logistic_regression"], params={"logistic_regression": {"C": 0}})
    assert [r["model"] for r in preds.select("model").distinct().collect()] == ["naive_bayes"]
    assert {r["model"]: r["stage"] for r in status.collect()} == {"naive_bayes": "done", "logistic_regression": "fit"}


def test_model_info():
    import json

    from pitchline.operators.models import MODEL_PARAMS, MODEL_TYPES, model_info
    for kind in MODEL_TYPES:
        info = model_info(kind, FEATURES, {"extra": 1})
        assert info["model_type"] == kind and info["n_features"] == 2 and info["feature_names"] == FEATURES
        assert set(json.loads(info["params"])) == set(MODEL_PARAMS[kind]) | {"extra"}
        assert info["uses_scaler"] == (kind in ("svm", "fnn", "logistic_regression", "naive_bayes"))
