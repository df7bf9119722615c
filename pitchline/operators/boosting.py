"""Second-order boosted trees for several classes (M7).

Every round grows one tree per class on the gradients and Hessians of the softmax
loss.  A level of all trees of a round is one pass: per (class, node, feature, bin)
the sums of gradient and Hessian are added up over the tasks, and the driver picks
the cuts from these sums.  L1 and L2 terms act on leaf weights and gains, rows and
columns are drawn by hash.  The margins of the rows are moved on every ``REWRITE``
rounds in the blocks that the executors keep, so that a pass adds up a bounded number
of trees; a lost block is made again from the file of bins and the trees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pitchline.operators.fitting import Fitted, Packed, as_block, draw, kept, matrix, of_block, row_bytes, softmax, task_sums
from pitchline.operators.trees import BINS, FLAT, best, binned, cut_points, empty_tree, reached, walk
from pitchline.session import remove_scratch

REWRITE = 5
MIN_HESSIAN = 1e-16
SEED_STREAMS = 1_000_003


def stream(seed: int, tree: int) -> int:
    """Row draws of a tree; its column draws use the next number."""
    return 2 * (seed * SEED_STREAMS + tree)


def columns_of(p: int, share: float, seed: int, tree: int) -> list[int]:
    """The columns of a tree: the share with the least draws, one at least."""
    d = draw(np.arange(p), stream(seed, tree) + 1)
    return sorted(np.argsort(d, kind="stable")[:max(1, int(p * share))].tolist())


def shrunk(g, alpha: float):
    """Gradient sum after the L1 term."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_weight(g, h, alpha: float, lam: float):
    return -shrunk(g, alpha) / (h + lam)


def score(g, h, alpha: float, lam: float):
    return shrunk(g, alpha) ** 2 / (h + lam)


def split_gains(hist: np.ndarray, alpha: float, lam: float, min_child: float) -> np.ndarray:
    """Gain of every cut of a node: ``hist`` is (features, bins, 2); cut j sends
    bins 0 to j left."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist.sum(axis=1, keepdims=True)
    right = whole - left
    gain = (score(left[..., 0], left[..., 1], alpha, lam) + score(right[..., 0], right[..., 1], alpha, lam)
            - score(whole[..., 0], whole[..., 1], alpha, lam))
    return np.where((left[..., 1] >= min_child) & (right[..., 1] >= min_child), gain, -np.inf)


def fit_boosted(data: Packed, n_estimators: int = 100, max_depth: int = 2, learning_rate: float = 0.03, subsample: float = 0.6,
                colsample_bytree: float = 0.5, reg_lambda: float = 10.0, reg_alpha: float = 2.0, min_child_weight: float = 1.0,
                random_state: int = 42, bins: int = BINS) -> Fitted:
    """Trees in rounds of one per class; ``state["loss"]`` is the mean training
    loss before each round."""
    spark, k, p = data.rows.sparkSession, len(data.classes), len(data.features)
    cuts, _ = cut_points(data.rows, p, bins)
    width = max((len(c) for c in cuts), default=0) + 1
    rows, path = binned(data, cuts, {"m": F.lit(bytes(8 * k))})
    blocks, before = kept(rows), None
    rounds: list[list[dict]] = []
    losses, stored_upto = [], 0
    eye = np.eye(k)

    def margins(batch, since):
        """Margins of the rows after the rounds ``since`` theirs, and their bins with a line per feature."""
        m, b = matrix(batch.column("m"), k).copy(), np.ascontiguousarray(matrix(batch.column("b"), p, np.int16).T)
        for trees in since:
            for c, t in enumerate(trees):
                m[:, c] += learning_rate * (reached(t, b, t["weight"], max_depth) if max_depth <= FLAT else np.asarray(t["weight"])[walk(t, b.T, "bin", max_depth)])
        return m, b

    for number in range(n_estimators):
        trees = [empty_tree(max_depth) for _ in range(k)]
        cols = [columns_of(p, colsample_bytree, random_state, number * k + c) for c in range(k)]
        m_cols = len(cols[0])
        # sums of gradient and Hessian of every node
        sums = [np.zeros((2 ** (max_depth + 1) - 1, 2)) for _ in range(k)]
        for level in range(max_depth):
            first, nodes = 2 ** level - 1, 2 ** level

            def of(batch, level=level, first=first, nodes=nodes, since=rounds[stored_upto:]):
                m, b = margins(batch, since)
                y, w, ids = (batch.column(c).to_numpy() for c in ("y", "w", "id"))
                prob = softmax(m)
                g, h = (prob - eye[y]) * w[:, None], np.maximum(2 * prob * (1 - prob) * w[:, None], MIN_HESSIAN)
                out = np.zeros((k, nodes, m_cols, width, 2))
                for c in range(k):
                    node = walk(trees[c], b.T, "bin", level) - first
                    used = np.flatnonzero((draw(ids, stream(random_state, number * k + c)) < subsample) & (node >= 0))
                    gc, hc, nc = g[used, c], h[used, c], node[used] * width
                    for i, f in enumerate(cols[c]):
                        at = nc + b[f][used]
                        out[c, :, i, :, 0] = np.bincount(at, gc, nodes * width).reshape(nodes, width)
                        out[c, :, i, :, 1] = np.bincount(at, hc, nodes * width).reshape(nodes, width)
                loss = -(w * np.log(prob[np.arange(len(y)), y])).sum()
                return np.concatenate([[loss, w.sum()], out.ravel()])

            s = task_sums(blocks, of, 2 + k * nodes * m_cols * width * 2)
            if level == 0:
                losses.append(s[0] / s[1])
            if before is not None:                       # the blocks after it are kept now
                before.unpersist()
                before = None
            hist = s[2:].reshape(k, nodes, m_cols, width, 2)
            for c in range(k):
                for v in range(nodes):
                    node = first + v
                    if level and trees[c]["feature"][(node - 1) // 2] < 0:
                        continue
                    sums[c][node] = hist[c, v, 0].sum(axis=0)
                    if width < 2:
                        continue
                    gains = split_gains(hist[c, v], reg_alpha, reg_lambda, min_child_weight)
                    i, j, gain = best(gains)
                    f = cols[c][i]
                    if gain <= 1e-6 or j >= len(cuts[f]):
                        continue
                    t = trees[c]
                    t["feature"][node], t["bin"][node], t["value"][node], t["gain"][node] = f, j, cuts[f][j], gain
                    left = hist[c, v, i, :j + 1].sum(axis=0)
                    sums[c][2 * node + 1], sums[c][2 * node + 2] = left, sums[c][node] - left
        for c in range(k):
            trees[c]["weight"] = leaf_weight(sums[c][:, 0], sums[c][:, 1], reg_alpha, reg_lambda).tolist()
        rounds.append(trees)
        if (number + 1) % REWRITE == 0 and number + 1 < n_estimators:

            def advance(block, since=rounds[stored_upto:]):
                batch = of_block(block)
                return as_block(batch.set_column(batch.schema.get_field_index("m"), "m", row_bytes(margins(batch, since)[0])))

            blocks, before, stored_upto = blocks.map(advance).persist(blocks.getStorageLevel()), blocks, len(rounds)
    blocks.unpersist()
    remove_scratch(spark, path)
    return Fitted("xgboost", data.features, data.classes, None, None,
                  {"rounds": rounds, "depth": max_depth, "rate": learning_rate, "loss": losses})


def margins_of(model: Fitted, x: np.ndarray) -> np.ndarray:
    """Class scores of raw feature rows."""
    s = model.state
    m = np.zeros((len(x), len(model.classes)))
    for trees in s["rounds"]:
        for c, t in enumerate(trees):
            m[:, c] += s["rate"] * np.asarray(t["weight"])[walk(t, x, "value", s["depth"])]
    return m


def importance(model: Fitted) -> dict[str, float]:
    """Mean gain of a feature's splits, as shares of all features' mean gains."""
    total, count = np.zeros(len(model.features)), np.zeros(len(model.features))
    for trees in model.state["rounds"]:
        for t in trees:
            for f, g in zip(t["feature"], t["gain"]):
                if f >= 0:
                    total[f] += g
                    count[f] += 1
    mean = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
    return dict(zip(model.features, (mean / (mean.sum() or 1.0)).tolist()))
