"""Feed-forward net with one hidden ReLU layer, L2 and early stopping.

An epoch is one pass over the packed rows: every task adds up the gradient of the
loss over its training rows and the loss over its validation rows at the same
weights, and an Adam step follows on the driver, whose state is the net's own
weights.  The last tenth of the rows in time stops the training once its loss has
not fallen for ``n_iter_no_change`` epochs; the best weights are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pitchline.operators import fitting
from pitchline.operators.fitting import Fitted, Packed, matrix, softmax, task_sums

BATCH = 200                    # rows that the reference's L2 term is shared by
FULL_BATCH_RATE = 20           # an epoch is one step here, about n / 200 there
DECAY1, DECAY2, EPSILON = 0.9, 0.999, 1e-8


def shapes(p: int, hidden: int, k: int) -> list[tuple[int, int]]:
    return [(p, hidden), (1, hidden), (hidden, k), (1, k)]


def unpacked(v: np.ndarray, p: int, hidden: int, k: int) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in shapes(p, hidden, k):
        out.append(v[at:at + a * b].reshape(a, b))
        at += a * b
    return out


def forward(v: np.ndarray, x: np.ndarray, hidden: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = unpacked(v, x.shape[1], hidden, k)
    h = np.maximum(x @ w1 + b1, 0.0)
    return h, softmax(h @ w2 + b2)


def loss_and_gradient(v: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int, k: int) -> tuple[float, np.ndarray]:
    """Sums over the rows, without the L2 term."""
    h, prob = forward(v, x, hidden, k)
    w2 = unpacked(v, x.shape[1], hidden, k)[2]
    d2 = prob - np.eye(k)[y]
    d1 = (d2 @ w2.T) * (h > 0)
    loss = -np.log(np.maximum(prob[np.arange(len(y)), y], 1e-300)).sum()
    return loss, np.concatenate([(x.T @ d1).ravel(), d1.sum(axis=0), (h.T @ d2).ravel(), d2.sum(axis=0)])


def start(p: int, hidden: int, k: int, seed: int) -> np.ndarray:
    """Uniform weights and intercepts within sqrt(6 / (inputs + outputs))."""
    rng = np.random.default_rng(seed)
    bound = [np.sqrt(6 / (p + hidden))] * 2 + [np.sqrt(6 / (hidden + k))] * 2
    return np.concatenate([rng.uniform(-b, b, a * c) for b, (a, c) in zip(bound, shapes(p, hidden, k))])


def fit_net(data: Packed, validation, hidden_layer_sizes=(16,), learning_rate_init: float = 0.001, max_iter: int = 200, random_state: int = 42,
            early_stopping: bool = True, alpha: float = 0.1, n_iter_no_change: int = 10, tol: float = 1e-4, **_ignored) -> Fitted:
    """``validation``: a condition on the packed rows, true for those that only
    measure; without any such row the training loss stops the training."""
    if len(hidden_layer_sizes) != 1:
        raise ValueError("one hidden layer is supported")
    hidden, k, p = hidden_layer_sizes[0], len(data.classes), len(data.features)
    rows = data.rows.select("xb", "y", (validation if early_stopping else F.lit(False)).alias("held"))
    held_n = rows.where("held").count()
    n = data.n - held_n
    if not n:
        raise ValueError("no training row beside the validation rows")
    rows = fitting.kept(rows)
    v = start(p, hidden, k, random_state)
    penal = np.concatenate([np.full(a * b, float(a > 1 or i % 2 == 0)) for i, (a, b) in enumerate(shapes(p, hidden, k))])
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    rate, lam = learning_rate_init * FULL_BATCH_RATE, alpha / min(BATCH, n)
    least, kept, waited, curve = np.inf, v.copy(), 0, []
    for epoch in range(1, max_iter + 1):

        def of(batch, v=v):
            x, y, held = matrix(batch.column("xb"), p), batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            loss, grad = loss_and_gradient(v, x[~held], y[~held], hidden, k)
            out, _ = loss_and_gradient(v, x[held], y[held], hidden, k) if held.any() else (0.0, None)
            return np.concatenate([[loss, out], grad])

        s = task_sums(rows, of, 2 + len(v))
        train = s[0] / n + 0.5 * lam * (penal * v * v).sum()
        watched = s[1] / held_n if held_n else train
        curve.append([float(train), float(watched)])
        if watched < least - tol:
            least, kept, waited = watched, v.copy(), 0
        else:
            waited += 1
            if waited >= n_iter_no_change:
                break
        g = s[2:] / n + lam * penal * v
        m1, m2 = DECAY1 * m1 + (1 - DECAY1) * g, DECAY2 * m2 + (1 - DECAY2) * g * g
        v = v - rate * (m1 / (1 - DECAY1 ** epoch)) / (np.sqrt(m2 / (1 - DECAY2 ** epoch)) + EPSILON)
    rows.unpersist()
    return Fitted("fnn", data.features, data.classes, data.center, data.scale,
                  {"weights": kept.tolist(), "hidden": hidden, "epochs": len(curve), "curve": curve})


def probabilities(model: Fitted, x: np.ndarray) -> np.ndarray:
    """Class probabilities of scaled feature rows."""
    return forward(np.asarray(model.state["weights"]), x, model.state["hidden"], len(model.classes))[1]
