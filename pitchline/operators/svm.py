"""Linear support vector classifier with probabilities (M9).

One hinge-loss model per pair of classes, and per pair and fold one that leaves the
fold out.  All of them are fitted together: a pass over the packed rows adds up the
gradients and Hessians of all models, another the objectives of a few step lengths.
The hinge is rounded off near the margin and the rounding made smaller level by
level, so that Newton steps apply.  The margins of left-out rows give a sigmoid
per pair, fitted by Newton steps whose sums are one Spark aggregate.  The pairs'
probabilities are coupled into class probabilities by the linear system of Wu, Lin
and Weng (2004); the predicted class has the most pairwise wins.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.operators.fitting import Fitted, Packed, draw, draw_column, kept, matrix, task_sums
from pitchline.session import remove_scratch, scratch_path

FOLDS = 5
FOLD_STREAM = 77
STEPS = 12                     # halvings of a Newton step tried
RIDGE = 1e-12
ROUNDINGS = (2.0, 0.3, 0.05, 0.01)     # widths of the rounded part of the hinge; half the last bounds the error
DAMPING = 1e-3                 # of the weight of the rows, against models without a row in the rounded part
TOLERANCE = 1e-6               # relative fall of the objective that ends a level


def decision(x: Column, weights: list[float]) -> Column:
    """w x + b; the last weight is b."""
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in weights[:-1]]), lambda a, b: a * b), F.lit(weights[-1]), lambda a, b: a + b)


def rounded_hinge(slack: np.ndarray, width: float) -> np.ndarray:
    """max(0, slack), quadratic for slacks from 0 to ``width``."""
    bent = np.clip(slack, 0.0, width)
    return bent * (slack - bent / 2) / width


def hinge_models(data: Packed, models: list[tuple[int, int, int | None]], c: float, folds: int, max_iter: int) -> np.ndarray:
    """Weights and intercept (last) of ``|w|^2 / 2 + c sum w_i hinge_i`` for every
    (class, class, fold left out or None)."""
    p = len(data.features) + 1
    rows = kept(data.rows.select("id", "y", "w", "xb"))

    def slices(batch, open_):
        """Per pair the numbers of its open models and what they share: rows, sides, weights
        (0 for rows that a model leaves out, a column each)."""
        x = np.column_stack([matrix(batch.column("xb"), p - 1), np.ones(batch.num_rows)])
        y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
        fold = np.floor(draw(batch.column("id").to_numpy(), FOLD_STREAM) * folds)
        for a, b in dict.fromkeys(m[:2] for m in models):
            mine = [i for i in sorted(open_) if models[i][:2] == (a, b)]
            used = np.flatnonzero((y == a) | (y == b))
            if mine and len(used):
                part = np.column_stack([w[used] * (fold[used] != models[i][2]) for i in mine])
                yield mine, x[used], np.where(y[used] == a, 1.0, -1.0)[:, None], part

    weights = np.zeros((len(models), p))
    penalty = np.append(np.ones(p - 1), 0.0)
    for width in ROUNDINGS:
        open_ = set(range(len(models)))
        for _ in range(max_iter):

            def derivatives(batch, weights=weights, open_=frozenset(open_)):
                grad, hess, size = np.zeros((len(models), p)), np.zeros((len(models), p, p)), np.zeros(len(models))
                for mine, x, s, w in slices(batch, open_):
                    slack = 1 - s * (x @ weights[mine].T)
                    grad[mine] = -(s * w * np.clip(slack / width, 0, 1)).T @ x
                    size[mine] = w.sum(axis=0)
                    for j, i in enumerate(mine):
                        bent = np.flatnonzero((slack[:, j] > 0) & (slack[:, j] < width) & (w[:, j] > 0))
                        hess[i] = (x[bent] * (w[bent, j] / width)[:, None]).T @ x[bent]
                return np.concatenate([grad.ravel(), hess.ravel(), size])

            n = len(models)
            v = c * task_sums(rows, derivatives, n * p * (p + 1) + n)
            grad = v[:n * p].reshape(n, p) + penalty * weights
            hess = v[n * p:n * p * (p + 1)].reshape(n, p, p) + np.diag(penalty)
            damped = hess + (DAMPING * v[-n:, None, None] + 1e-12) * np.eye(p)
            step = -np.linalg.solve(damped, grad[:, :, None])[:, :, 0]
            lengths = 0.5 ** np.arange(STEPS)

            def objectives(batch, weights=weights, step=step, open_=frozenset(open_)):
                out = np.zeros((len(models), STEPS + 1))
                for mine, x, s, w in slices(batch, open_):
                    at, move = 1 - s * (x @ weights[mine].T), s * (x @ step[mine].T)
                    for j, length in enumerate([0.0, *lengths]):
                        out[mine, j] = np.einsum("ij,ij->j", w, rounded_hinge(at - length * move, width))
                return out.ravel()

            cost = c * task_sums(rows, objectives, len(models) * (STEPS + 1)).reshape(len(models), STEPS + 1)
            for i in list(open_):
                size = np.concatenate([[0.0], lengths])
                total = cost[i] + np.array([0.5 * (penalty * (weights[i] + t * step[i]) ** 2).sum() for t in size])
                j = int(total.argmin())
                weights[i] = weights[i] + size[j] * step[i]
                if total[0] - total[j] <= TOLERANCE * max(1.0, abs(total[0])):
                    open_.discard(i)
            if not open_:
                break
    rows.unpersist()
    return weights


def sigmoid_fit(held: DataFrame, pairs: int, max_iter: int = 100) -> list[tuple[float, float]]:
    """(A, B) of every pair: ``held`` has (pair, f, label), and
    ``P(label 1 | f) = 1 / (1 + exp(A f + B))`` fits targets
    (n+ + 1) / (n+ + 2) and 1 / (n- + 2) (Platt, 1999; Lin, Lin and Weng, 2007)."""
    n = {(r["pair"], int(r["label"])): r["count"] for r in held.groupBy("pair", "label").count().collect()}
    size = [[n.get((i, s), 0) for s in (0, 1)] for i in range(pairs)]
    high, low = [(b + 1) / (b + 2) for _, b in size], [1 / (a + 2) for a, _ in size]
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("pair") + 1)
    held = held.withColumn("t", F.when(F.col("label") == 1, at(high)).otherwise(at(low)))
    ab = [(0.0, math.log((a + 1) / (b + 1))) for a, b in size]
    open_ = {i for i in range(pairs) if sum(size[i])}

    def cost(a, b):
        z = a * F.col("f") + b
        return F.when(z >= 0, F.col("t") * z + F.log1p(F.exp(-z))).otherwise((F.col("t") - 1) * z + F.log1p(F.exp(z)))

    for _ in range(max_iter):
        if not open_:
            break
        a, b = at([x for x, _ in ab]), at([x for _, x in ab])
        z = a * F.col("f") + b
        p = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
        d1, d2, f = F.col("t") - p, p * (1 - p), F.col("f")
        sums = {r["pair"]: r for r in held.groupBy("pair").agg(
            F.sum(f * f * d2).alias("h11"), F.sum(d2).alias("h22"), F.sum(f * d2).alias("h21"),
            F.sum(f * d1).alias("g1"), F.sum(d1).alias("g2"), F.sum(cost(a, b)).alias("cost")).collect()}
        step = {}
        for i in list(open_):
            s = sums[i]
            if abs(s["g1"]) < 1e-5 and abs(s["g2"]) < 1e-5:
                open_.discard(i)
                continue
            h11, h22, h21 = s["h11"] + RIDGE, s["h22"] + RIDGE, s["h21"]
            det = h11 * h22 - h21 * h21
            step[i] = (-(h22 * s["g1"] - h21 * s["g2"]) / det, -(h11 * s["g2"] - h21 * s["g1"]) / det)
        if not step:
            break
        da, db = at([step.get(i, (0, 0))[0] for i in range(pairs)]), at([step.get(i, (0, 0))[1] for i in range(pairs)])
        tried = {r["pair"]: r for r in held.groupBy("pair").agg(*[F.sum(cost(a + da / 2 ** j, b + db / 2 ** j)).alias(f"c{j}") for j in range(STEPS)]).collect()}
        for i, (x, y) in step.items():
            slope = sums[i]["g1"] * x + sums[i]["g2"] * y
            j = next((j for j in range(STEPS) if tried[i][f"c{j}"] < sums[i]["cost"] + 1e-4 / 2 ** j * slope), None)
            if j is None:                                 # as good as it gets
                open_.discard(i)
                continue
            ab[i] = (ab[i][0] + x / 2 ** j, ab[i][1] + y / 2 ** j)
    return ab


def couple(r: np.ndarray) -> np.ndarray:
    """Class probabilities of pairwise ones: ``r[:, i, j]`` is P(i | i or j)."""
    n, k = r.shape[0], r.shape[1]
    r = np.clip(r, 1e-7, 1 - 1e-7)
    if k == 1:
        return np.ones((n, 1))
    off = ~np.eye(k, dtype=bool)
    q = np.where(off, -np.swapaxes(r, 1, 2) * r, 0.0)
    q[:, np.arange(k), np.arange(k)] = np.where(off, np.swapaxes(r, 1, 2) ** 2, 0.0).sum(axis=2)
    m = np.zeros((n, k + 1, k + 1))
    m[:, :k, :k], m[:, :k, k], m[:, k, :k] = q, 1.0, 1.0
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1.0
    p = np.clip(np.linalg.solve(m, right)[:, :k, 0], 0.0, None)
    return p / p.sum(axis=1, keepdims=True)


def fit_svm(data: Packed, c: float = 0.1, max_iter: int = 50, folds: int = FOLDS) -> Fitted:
    spark, k = data.rows.sparkSession, len(data.classes)
    pairs = list(combinations(range(k), 2))
    if not pairs:
        return Fitted("svm", data.features, data.classes, data.center, data.scale, {"pairs": [], "weights": [], "sigmoid": []})
    fold = F.floor(draw_column(F.col("id"), FOLD_STREAM) * folds).cast("int")
    models = [(a, b, g) for a, b in pairs for g in (None, *range(folds))]
    found = hinge_models(data, models, c, folds, max_iter)
    size = {(r["y"], r["fold"]): r["n"] for r in data.rows.groupBy("y", fold.alias("fold")).agg(F.count("*").alias("n")).collect()}
    held = None
    for i, (a, b) in enumerate(pairs):
        rows = data.rows.where(F.col("y").isin(a, b)).select((F.col("y") == a).cast("double").alias("label"), "x", fold.alias("fold"))
        f = F.lit(0.0)
        for m, (p, q, g) in enumerate(models):
            if (p, q) != (a, b) or g is None:
                continue
            left = [sum(n for (y, h), n in size.items() if y == side and h != g) for side in (a, b)]
            # without one of the classes among the other folds there is no model
            value = decision(F.col("x"), found[m].tolist()) if min(left) else F.lit(1.0 if left[0] else -1.0 if left[1] else 0.0)
            f = F.when(F.col("fold") == g, value).otherwise(f)
        part = rows.select(F.lit(i).alias("pair"), f.alias("f"), "label")
        held = part if held is None else held.union(part)
    path = scratch_path(spark, "svm-held")
    held.write.parquet(path)
    ab = sigmoid_fit(spark.read.parquet(path), len(pairs))
    remove_scratch(spark, path)
    whole = [found[m].tolist() for m, (_, _, g) in enumerate(models) if g is None]
    return Fitted("svm", data.features, data.classes, data.center, data.scale, {"pairs": pairs, "weights": whole, "sigmoid": ab})


def scores(model: Fitted, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class index by pairwise wins, the first on ties; class probabilities) of
    scaled feature rows."""
    k, s = len(model.classes), model.state
    r, wins = np.full((len(x), k, k), 0.5), np.zeros((len(x), k))
    for (a, b), w, (slope, shift) in zip(s["pairs"], s["weights"], s["sigmoid"]):
        f = x @ np.asarray(w[:-1]) + w[-1]
        z = np.clip(slope * f + shift, -700, 700)
        r[:, a, b] = 1 / (1 + np.exp(z))
        r[:, b, a] = 1 - r[:, a, b]
        wins[:, a] += f > 0
        wins[:, b] += f <= 0
    return wins.argmax(axis=1), couple(r)


def importance(model: Fitted) -> dict[str, float]:
    """Mean absolute weight over the pairs."""
    w = np.abs(np.array(model.state["weights"]))[:, :-1]
    return dict(zip(model.features, w.mean(axis=0).tolist()))
