"""Feature screening.

The feature matrix stays distributed: variances are one aggregation pass, all
pairwise Pearson correlations one scan of partial moment matrices.  Only the
tiny derived tables (pairs, components) are iterated, and those are bounded by
p^2, not by rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchline.operators.graph import components
from pitchline.operators.prep import q

CORR_GROUP_LIMIT = 0.8      # pairs reported and grouped
REDUNDANT_LIMIT = 0.9       # redundant feature limit
LOW_VARIANCE_LIMIT = 0.01


def variances(x: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, variance) with sample variance, in one pass."""
    row = x.agg(*[F.var_samp(q(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    st = F.stack(F.lit(len(cols)), *[e for i, c in enumerate(cols) for e in (F.lit(c), F.col(f"v{i}"))])
    return row.select(st.alias("feature", "variance"))


def low_variance(x: DataFrame, cols: list[str], limit: float = LOW_VARIANCE_LIMIT) -> DataFrame:
    """A5: features with sample variance below ``limit``."""
    return variances(x, cols).where(F.col("variance") < limit)


def corr_pairs_all(x: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every pair i < j (column order) over the rows where
    both are present, as pandas does; NULL for a constant column.

    Two passes: the column means (one scalar subquery; any shift is exact, the
    mean keeps the sums small), then one scan that turns every Arrow batch into
    its p x p matrices of pair counts, sums and products.  The partial sums of
    a batch are p^2 rows whatever its length; they are added per pair in one
    aggregate, so the plan does not grow with p."""
    if len(cols) < 2:
        return x.sparkSession.createDataFrame([], "feature_1 string, feature_2 string, correlation double")
    means = x.select(F.struct(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)])).scalar()
    cen = x.select(*[(q(c).cast("double") - means.getField(f"m{i}")).alias(f"c{i}") for i, c in enumerate(cols)])
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def moments(batches):
        p = len(cols)
        total = np.zeros((len(names), p, p))
        for batch in batches:
            a = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)], axis=1)
            there = (~np.isnan(a)).astype(float)
            a = np.where(there > 0, a, 0.0)
            total += np.stack([there.T @ there, a.T @ there, there.T @ a, (a * a).T @ there, there.T @ (a * a), a.T @ a])
        i, j = np.triu_indices(p, 1)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), **{n: total[k][i, j] for k, n in enumerate(names)}})

    parts = cen.mapInArrow(moments, "i int, j int, " + ", ".join(f"{n} double" for n in names))
    t = parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    # n * variance of each side over the common rows; 0 up to rounding if constant
    vx, vy = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n") for c in "xy")
    flat = (vx <= F.lit(1e-12) * F.col("sxx")) | (vy <= F.lit(1e-12) * F.col("syy"))
    r = F.when((F.col("n") > 0) & ~flat, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    name = F.array(*[F.lit(c) for c in cols])
    return t.select(F.element_at(name, F.col("i") + 1).alias("feature_1"), F.element_at(name, F.col("j") + 1).alias("feature_2"),
                    r.alias("correlation"))


def high_corr_pairs(pairs: DataFrame, limit: float = CORR_GROUP_LIMIT) -> DataFrame:
    """Pairs with |r| > limit (NaN / NULL excluded first)."""
    p = pairs.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    return p.where(F.abs("correlation") > limit).withColumn("abs_correlation", F.abs("correlation"))


def redundant_features(pairs: DataFrame, limit: float = REDUNDANT_LIMIT) -> DataFrame:
    """A column is redundant when any *earlier* column has |r| > limit
    (not greedy: a redundant column still marks later ones)."""
    return high_corr_pairs(pairs, limit).select(F.col("feature_2").alias("feature")).distinct()


def correlation_groups(pairs: DataFrame) -> DataFrame:
    """Connected components of the pair graph.  Returns (feature, group,
    group_size) with ``group`` = smallest feature name of the component."""
    labels = components(pairs, "feature_1", "feature_2").withColumnRenamed("node", "feature")
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("group_size"))
    return labels.join(size, "label").select("feature", F.col("label").alias("group"), "group_size")


def keep_drop(groups: DataFrame, importance: DataFrame) -> DataFrame:
    """Per group keep the most important feature (ties: name), drop the
    rest.  ``importance`` is (feature, importance); missing -> 0."""
    g = groups.join(importance, "feature", "left").withColumn(
        "importance", F.coalesce(F.col("importance"), F.lit(0.0)))
    r = F.row_number().over(Window.partitionBy("group").orderBy(F.col("importance").desc(), F.col("feature")))
    return g.select("group", "group_size", "feature", "importance",
                    F.when(r == 1, "keep").otherwise("drop").alias("action"))


def kept_features(all_features: DataFrame, decisions: DataFrame) -> DataFrame:
    """U4: features minus the dropped ones."""
    return all_features.join(decisions.where(F.col("action") == "drop").select("feature"), "feature", "left_anti")


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The n highest scores (ties by name) -> TakeOrderedAndProject."""
    return importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


def corr_submatrix(pairs: DataFrame, n_pairs: int = 40, n_features: int = 30, limit: float = CORR_GROUP_LIMIT) -> DataFrame:
    """T5: the features of the ``n_pairs`` strongest pairs above ``limit``, the
    first ``n_features`` of them by name, and the square matrix among them
    (both triangles and a diagonal of ones) in long form."""
    # strength rounded to 9 places: equal-by-construction pairs tie exactly
    strength = F.round(F.abs("correlation"), 9)
    top = high_corr_pairs(pairs, limit).orderBy(strength.desc(), "feature_1", "feature_2").limit(n_pairs)
    names = top.select(F.explode(F.array("feature_1", "feature_2")).alias("feature")).distinct()
    chosen = names.orderBy("feature").limit(n_features).checkpoint(eager=True)      # n_features rows
    a, b = (chosen.withColumnRenamed("feature", f"feature_{i}") for i in (1, 2))
    upper = pairs.join(a, "feature_1", "left_semi").join(b, "feature_2", "left_semi").select("feature_1", "feature_2", "correlation")
    lower = upper.select(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "correlation")
    diagonal = a.select("feature_1", F.col("feature_1").alias("feature_2"), F.lit(1.0).alias("correlation"))
    return upper.unionByName(lower).unionByName(diagonal)


def screening_report(x: DataFrame, cols: list[str], importance: DataFrame | None = None,
                     n_top: int = 30) -> DataFrame:
    """(feature, reason) for low variance, redundancy and, when importances
    are given, selection by importance, and one row ``total_features`` with the
    number of columns in place of a name."""
    pairs = corr_pairs_all(x, cols)
    total = x.sparkSession.range(1).select(F.lit(str(len(cols))).alias("feature"), F.lit("total_features").alias("reason"))
    out = low_variance(x, cols).select("feature", F.lit("low_variance").alias("reason")).unionByName(
        redundant_features(pairs).select("feature", F.lit("redundant").alias("reason"))).unionByName(total)
    if importance is not None:
        out = out.unionByName(top_features(importance, n_top).select("feature", F.lit("selected_by_importance")
                                                                     .alias("reason")))
    return out


def average_importance(importances: DataFrame, normalise: bool = False) -> DataFrame:
    """(model, feature, importance) -> mean over the models that scored
    the feature: raw scales as in the reference, or, with ``normalise``, each
    model's scores divided by their sum."""
    if normalise:
        total = F.sum("importance").over(Window.partitionBy("model"))
        importances = importances.withColumn("importance", F.try_divide("importance", total))
    return importances.groupBy("feature").agg(F.avg("importance").alias("importance"))


def importance_by_model(importances: DataFrame, models: list[str]) -> DataFrame:
    """A14 table: one column per model, 0 where a model has no score."""
    p = importances.groupBy("feature").pivot("model", models).agg(F.first("importance"))
    return p.select("feature", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in models])


def target_correlation(x: DataFrame, cols: list[str], label: str) -> DataFrame:
    """A deterministic univariate importance: |corr(feature, label)|."""
    row = x.agg(*[F.abs(F.try_divide(F.covar_samp(q(c), F.col(label)),
                                     F.nullif(F.stddev_samp(q(c)) * F.stddev_samp(label), F.lit(0.0)))).alias(f"i{k}")
                  for k, c in enumerate(cols)])
    st = F.stack(F.lit(len(cols)), *[e for k, c in enumerate(cols) for e in (F.lit(c), F.col(f"i{k}"))])
    # rounded to 9 places so that mathematically equal scores (a scaled copy
    # of a column) tie exactly and the name decides, in any engine
    return row.select(st.alias("feature", "importance")).withColumn(
        "importance", F.round(F.coalesce(F.col("importance"), F.lit(0.0)), 9))


def permutation_importance(df: DataFrame, features: list[str], predict, label: str, key: str, seed: int = 42) -> DataFrame:
    """M11 for any classifier: the fall of accuracy when one feature's values are
    shuffled over the rows, (feature, accuracy, permuted_accuracy, importance).

    ``predict`` maps {feature: column} to the predicted label.  The row at place r
    of the order of ``key`` (unique) takes the value of the row at place r of an
    order by hash, one shuffle for all features: two range sorts of narrow rows and
    a join by place.  Rows without a label do not count."""
    from pitchline.operators.fitting import draw_column
    from pitchline.operators.splits import positional_index
    rows = df.where(q(label).isNotNull()).select(key, q(label).alias("_label"), *[q(c) for c in features])
    mine = positional_index(rows, [F.col(key)], "_pos")
    other = positional_index(rows.select(key, *[q(c).alias(f"_other{i}") for i, c in enumerate(features)]), [draw_column(F.col(key), seed), F.col(key)], "_pos")
    j = mine.join(other.drop(key), "_pos")
    own = {c: q(c) for c in features}
    hit = lambda values: F.count_if(predict(values) == F.col("_label"))
    r = j.agg(F.count(F.lit(1)).alias("n"), hit(own).alias("all"), *[hit(own | {c: F.col(f"_other{i}")}).alias(f"f{i}") for i, c in enumerate(features)])
    wide = r.select("n", "all", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("hits")) for i, c in enumerate(features)])).alias("f"))
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    return wide.select("f.feature", share("all").alias("accuracy"), share("f.hits").alias("permuted_accuracy"), (share("all") - share("f.hits")).alias("importance"))
