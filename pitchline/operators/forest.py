"""Random forest with reproducible draws (M5).

A row's place in a tree's bootstrap sample is drawn by hash of (tree, row), the
features of a node by hash of (tree, node), so the forest depends on the rows only,
not on their order or partitions.  All trees grow together, a level per pass: every
task adds up class weights and row counts per (tree, node, feature, bin), the
arrays of a tree meet in one task by key, which picks the cuts, and only these come
to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pitchline.operators.fitting import Fitted, Packed, draw, matrix
from pitchline.operators.trees import BINS, FLAT, best, binned, cut_points, empty_tree, reached, walk
from pitchline.session import remove_scratch

STREAMS = 1_000_003
MOST = 7                       # times that a row is drawn at most: beyond is under 1e-5
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(MOST)])


def bag_stream(seed: int, tree: int) -> int:
    return seed * STREAMS + 64 * tree


def bag_counts(ids, seed: int, tree: int) -> np.ndarray:
    """Times that every row is in the tree's sample: Poisson of mean 1, the limit
    of drawing n of n with replacement."""
    return np.searchsorted(POISSON, draw(ids, bag_stream(seed, tree)), side="right")


def features_of(p: int, m: int, seed: int, tree: int, node: int) -> list[int]:
    """The ``m`` features tried at a node: those of the least draws."""
    return sorted(np.argsort(draw(np.arange(p), bag_stream(seed, tree) + 1 + node), kind="stable")[:m].tolist())


def gini_gains(hist: np.ndarray, min_leaf: int) -> np.ndarray:
    """Fall of the weighted impurity of every cut; ``hist`` is (features, bins,
    classes + 1), the last one the rows."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist.sum(axis=1, keepdims=True)
    right = whole - left
    pure = lambda h: np.divide((h[..., :-1] ** 2).sum(-1), h[..., :-1].sum(-1), out=np.zeros(h.shape[:-1]), where=h[..., :-1].sum(-1) > 0)
    gain = pure(left) + pure(right) - pure(whole)
    return np.where((left[..., -1] >= min_leaf) & (right[..., -1] >= min_leaf), gain, -np.inf)


def tries(p: int, max_features) -> int:
    if max_features == "sqrt":
        return max(1, int(math.sqrt(p)))
    return p if max_features is None else max(1, int(max_features if max_features >= 1 else p * max_features))


def fit_forest(data: Packed, n_estimators: int = 100, max_depth: int = 4, min_samples_split: int = 30, min_samples_leaf: int = 15,
               max_features="sqrt", random_state: int = 42, bins: int = BINS) -> Fitted:
    """``min_samples_split`` and ``min_samples_leaf`` count the rows of the sample
    once each, however often they were drawn."""
    spark, k, p = data.rows.sparkSession, len(data.classes), len(data.features)
    m = tries(p, max_features)
    cuts, middles = cut_points(data.rows, p, bins)
    width = max((len(c) for c in cuts), default=0) + 1
    parts = min(spark.sparkContext.defaultParallelism, data.n // 2000 + 1)
    # a row's places in all samples are drawn once and kept, a byte per tree
    rows, path = binned(data, cuts, drawn=lambda ids: np.column_stack([bag_counts(ids, random_state, t) for t in range(n_estimators)]), parts=parts)
    trees = [empty_tree(max_depth) | {"dist": [[0.0] * k for _ in range(2 ** (max_depth + 1) - 1)]} for _ in range(n_estimators)]
    for level in range(max_depth):
        first, nodes = 2 ** level - 1, 2 ** level
        open_ = [t for t in range(n_estimators) if level == 0 or any(f >= 0 for f in trees[t]["feature"][first // 2:first])]
        tried = {t: [features_of(p, m, random_state, t, first + v) for v in range(nodes)] for t in open_}

        ids_of = np.arange(first + nodes, dtype=np.int16 if level < 15 else np.int64)

        def count(batches, level=level, first=first, nodes=nodes, open_=open_, tried=tried, ids_of=ids_of):
            total = {t: np.zeros((nodes, m, width, k + 1)) for t in open_}
            for batch in batches:
                if not batch.num_rows:
                    continue
                # a line per feature and per tree
                b = np.ascontiguousarray(matrix(batch.column("b"), p, np.int16).T)
                drawn = np.ascontiguousarray(matrix(batch.column("n"), n_estimators, np.uint8).T)
                y, w = (batch.column(c).to_numpy() for c in ("y", "w"))
                for t in open_:
                    in_bag = np.flatnonzero(drawn[t])
                    node = reached(trees[t], b, ids_of, level) if level <= FLAT else walk(trees[t], b.T, "bin", level)
                    node = np.broadcast_to(node, len(y))[in_bag].astype(np.int16 if level < 15 else np.int64)
                    order = np.argsort(node, kind="stable")
                    in_bag, node = in_bag[order], node[order]
                    ends = np.searchsorted(node, np.arange(first, first + nodes + 1))
                    for v in range(nodes):
                        used = in_bag[ends[v]:ends[v + 1]]
                        if not len(used):
                            continue
                        weight, yu = drawn[t][used] * w[used], y[used]
                        for i, f in enumerate(tried[t][v]):
                            at = b[f][used].astype(np.int64)
                            total[t][v, i, :, :k] += np.bincount(at * k + yu, weight, width * k).reshape(width, k)
                            total[t][v, i, :, k] += np.bincount(at, minlength=width)
            for t in open_:
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([total[t].ravel()], pa.list_(pa.float64()))], names=["tree", "v"])

        def choose(batches, first=first, nodes=nodes, tried=tried):
            at, total = None, None

            def split():
                hist = total.reshape(nodes, m, width, k + 1)
                for v in range(nodes):
                    whole = hist[v, 0].sum(axis=0)
                    f, j, gain, left = -1, 0, 0.0, [0.0] * k
                    if width > 1 and whole[k] >= min_samples_split:
                        i, j, gain = best(gini_gains(hist[v], min_samples_leaf))
                        if gain > 1e-9 and j < len(cuts[tried[at][v][i]]):
                            f, left = tried[at][v][i], hist[v, i, :j + 1, :k].sum(axis=0).tolist()
                    yield at, first + v, f, j, gain, whole[:k].tolist(), left

            out = []
            for batch in batches:
                for t, v in zip(batch.column("tree").to_pylist(), batch.column("v")):
                    if t != at:
                        out += list(split()) if at is not None else []
                        at, total = t, 0
                    total = total + v.values.to_numpy()
            out += list(split()) if at is not None else []
            yield pa.RecordBatch.from_pylist([dict(zip(_SPLIT.names, r)) for r in out], schema=_SPLIT)

        parts = rows.mapInArrow(count, "tree int, v array<double>")
        found = parts.repartition("tree").sortWithinPartitions("tree").mapInArrow(
            choose, "tree int, node int, feature int, bin int, gain double, whole array<double>, left array<double>")
        for r in found.collect():                    # one row per tree and node of the level
            t, v = trees[r["tree"]], r["node"]
            if level and t["feature"][(v - 1) // 2] < 0:
                continue
            t["dist"][v] = list(r["whole"])
            if r["feature"] >= 0:
                t["feature"][v], t["bin"][v], t["gain"][v] = r["feature"], r["bin"], r["gain"]
                t["value"][v] = middles[r["feature"]][r["bin"]]
                t["dist"][2 * v + 1], t["dist"][2 * v + 2] = list(r["left"]), [a - b for a, b in zip(r["whole"], r["left"])]
    remove_scratch(spark, path)
    for t in trees:
        t["dist"] = [[x / (sum(d) or 1.0) for x in d] for d in t["dist"]] if sum(t["dist"][0]) else [[1.0 / k] * k for _ in t["dist"]]
        total = sum(t["gain"][i] for i, f in enumerate(t["feature"]) if f >= 0)
        t["total"] = total
    return Fitted("random_forest", data.features, data.classes, None, None, {"trees": trees, "depth": max_depth})


_SPLIT = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()),
                    ("whole", pa.list_(pa.float64())), ("left", pa.list_(pa.float64()))])


def distribution(model: Fitted, x: np.ndarray) -> np.ndarray:
    """Mean class distribution of the leaves that raw feature rows reach."""
    s = model.state
    return sum(np.asarray(t["dist"])[walk(t, x, "value", s["depth"])] for t in s["trees"]) / len(s["trees"])


def importance(model: Fitted) -> dict[str, float]:
    """Mean over the trees of a feature's share of the impurity fall."""
    out = np.zeros(len(model.features))
    grown = 0
    for t in model.state["trees"]:
        if t["total"] > 0:
            grown += 1
            for f, g in zip(t["feature"], t["gain"]):
                if f >= 0:
                    out[f] += g / t["total"]
    return dict(zip(model.features, (out / max(1, grown)).tolist()))
