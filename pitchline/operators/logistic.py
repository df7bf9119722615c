"""Multinomial logistic regression by Newton steps (M6).

The objective is ``sum w_i loss_i + |W|^2 / (2 C)``, intercepts free, as the
reference's solver has it.  A step is one pass: loss, gradient and the
``K (p + 1)`` square Hessian are summed over the tasks.  The optimum does not
depend on a solver, so the passes go on until the gradient vanishes.
"""

from __future__ import annotations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchline.operators.fitting import Fitted, Packed, kept, matrix, softmax, task_sums

TOLERANCE = 1e-10              # of the gradient, per unit of weight


def derivatives(blocks: RDD, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted loss, gradient and Hessian at ``weights`` (classes x features + 1)."""
    k, p = weights.shape
    eye = np.eye(k)

    def of(batch):
        x = np.column_stack([matrix(batch.column("xb"), p - 1), np.ones(batch.num_rows)])
        y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
        prob = softmax(x @ weights.T)
        loss = -(w * np.log(prob[np.arange(len(y)), y])).sum()
        grad = ((prob - eye[y]) * w[:, None]).T @ x
        hess = np.zeros((k, p, k, p))
        for a in range(k):
            for b in range(a + 1, k):                    # the blocks of a class add up to 0
                h = -(x * (w * prob[:, a] * prob[:, b])[:, None]).T @ x
                hess[a, :, b, :], hess[b, :, a, :] = h, h
                hess[a, :, a, :] -= h
                hess[b, :, b, :] -= h
        return np.concatenate([[loss], grad.ravel(), hess.ravel()])

    s = task_sums(blocks, of, 1 + k * p + (k * p) ** 2)
    return s[0], s[1:1 + k * p].reshape(k, p), s[1 + k * p:].reshape(k * p, k * p)


def fit_logistic(data: Packed, c: float = 0.01, max_iter: int = 1000) -> Fitted:
    k, p = len(data.classes), len(data.features) + 1
    penalty = np.full((k, p), 1.0 / c)
    penalty[:, -1] = 0.0
    w, step, last = np.zeros((k, p)), np.zeros((k, p)), np.inf
    total, passes, norm = None, 0, np.inf
    blocks = kept(data.rows.select("xb", "y", "w"))
    while passes < max_iter:
        loss, grad, hess = derivatives(blocks, w)
        passes += 1
        value = loss + 0.5 * (penalty * w * w).sum()
        total = total or loss / np.log(k) if k > 1 else 1.0            # all weights, from the loss at 0
        if value > last + 1e-12 * abs(last) and np.abs(step).max() > 1e-12:
            step = step / 2                                            # the Newton step went too far
            w = w - step
            continue
        grad = grad + penalty * w
        norm = float(np.abs(grad).max())
        if norm <= TOLERANCE * total:
            break
        last = value
        # intercepts may all move together: the smallest step is taken
        step = -np.linalg.lstsq(hess + np.diag(penalty.ravel()), grad.ravel(), rcond=1e-12)[0].reshape(k, p)
        w = w + step
    blocks.unpersist()
    return Fitted("logistic_regression", data.features, data.classes, data.center, data.scale,
                  {"weights": w.tolist(), "passes": passes, "gradient": norm})


def probabilities(model: Fitted) -> Column:
    """Class probabilities as an array, in class order."""
    x = model.inputs()
    plus = lambda a, b: a + b
    score = [F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in row[:-1]]), lambda a, b: a * b), F.lit(row[-1]), plus) for row in model.state["weights"]]
    return softmax_column(F.array(*score))


def softmax_column(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda v: v / total)


def importance(model: Fitted) -> dict[str, float]:
    """Mean absolute coefficient over the classes."""
    w = np.abs(np.array(model.state["weights"]))[:, :-1]
    return dict(zip(model.features, w.mean(axis=0).tolist()))
