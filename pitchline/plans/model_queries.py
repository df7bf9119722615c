"""Queries over fitted models: optimum, splits, importance, isolated failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchline.plans import model_sql as sql
from pitchline.plans.common import finish

LABEL = "target_match_result"


def q_logistic_optimum(spark, sf_dir):
    """M6: coefficients at the optimum, which no solver's path enters."""
    from pitchline.operators.models import fit
    from pitchline.plans.registry import _model_data
    m = fit(_model_data(spark, sf_dir)["train"], sql.FEW_FEATURES, "logistic_regression")
    rows = [(c, f, w) for c, ws in zip(m.classes, m.state["weights"]) for f, w in zip([*m.features, "intercept"], ws)]
    return finish(spark.createDataFrame(rows, "class string, feature string, coefficient double"))


def q_boosted_first_round(spark, sf_dir):
    """M7: cuts, gains and leaf weights of the first round's trees."""
    from pitchline.operators.models import fit
    from pitchline.plans.registry import HT_NUMERIC, _model_data
    m = fit(_model_data(spark, sf_dir)["train"], HT_NUMERIC, "xgboost", {"n_estimators": 1})
    rows = [(c, n, HT_NUMERIC[t["feature"][n]], t["value"][n], t["gain"][n], t["weight"][2 * n + 1], t["weight"][2 * n + 2])
            for c, t in zip(m.classes, m.state["rounds"][0]) for n in range(3) if t["feature"][n] >= 0]
    return finish(spark.createDataFrame(rows, "class string, node int, feature string, cut double, gain double, left_weight double, right_weight double"))


def q_forest_roots(spark, sf_dir):
    """M5: bootstrap samples and root splits of the first five trees."""
    from pitchline.operators.forest import bag_counts
    from pitchline.operators.models import fit
    from pitchline.plans.registry import HT_NUMERIC, _model_data
    train = _model_data(spark, sf_dir)["train"]
    m = fit(train, HT_NUMERIC, "random_forest", {"n_estimators": 5, "max_depth": 1})
    rows = [(t, HT_NUMERIC[x["feature"][0]], x["value"][0], x["gain"][0]) for t, x in enumerate(m.state["trees"])]

    def bags(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros((5, 2), dtype=np.int64)
        for b in batches:
            for t in range(5):
                n = bag_counts(b.column(0).to_numpy(), 42, t)
                total[t] += (int((n > 0).sum()), int(n.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(range(5), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["tree", "rows_in", "drawn"])

    bag = train.select("match_id").mapInArrow(bags, "tree int, rows_in long, drawn long").groupBy("tree").agg(F.sum("rows_in").alias("rows_in"), F.sum("drawn").alias("drawn"))
    return finish(bag.join(spark.createDataFrame(rows, "tree int, feature string, cut double, gain double"), "tree"))


def q_permutation_importance(spark, sf_dir):
    """M11 of the strength rule; a feature that it does not read has none."""
    from pitchline.operators.screening import permutation_importance
    from pitchline.sources.tables import matches

    def rule(x):
        return (F.when(x["home_ppg"] > x["away_ppg"] + 0.5, "H").when(x["away_ppg"] > x["home_ppg"] + 0.5, "A").otherwise("D"))

    return finish(permutation_importance(matches(spark, sf_dir), ["home_ppg", "away_ppg", "home_xg"], rule, "result", "match_id"))


def q_model_failures(spark, sf_dir):
    """Planted failures show as rows beside the models that were trained."""
    from pitchline.operators.models import compare_models
    from pitchline.plans.registry import HT_NUMERIC, _model_data
    d = _model_data(spark, sf_dir)
    preds, _, status = compare_models(d["train"], {"test": d["test"]}, HT_NUMERIC, ["naive_bayes", "logistic_regression", "xgboost", "no_such_model"],
                                      params={"xgboost": {"no_such_parameter": 1}})
    made = preds.where("split = 'test'").groupBy("model").agg(F.count(F.lit(1)).alias("test_rows"))
    return finish(status.join(made, "model", "left").select("model", "stage", F.substring_index("message", ":", 1).alias("message"),
                                                            F.coalesce("test_rows", F.lit(0)).alias("test_rows")))


REGISTERED = [
    ("logistic_optimum", sql.logistic_optimum_sql, q_logistic_optimum),
    ("boosted_first_round", sql.boosted_first_round_sql, q_boosted_first_round),
    ("forest_roots", sql.forest_roots_sql, q_forest_roots),
    ("permutation_importance", sql.permutation_importance_sql, q_permutation_importance),
    ("model_failures", sql.model_failures_sql, q_model_failures),
]
