"""Binned features and vectorised binary trees, for boosting and forests.

A tree of depth D is an array of nodes, node i with children 2 i + 1 and 2 i + 2;
``feature`` is -1 at leaves.  A row goes left where its value is at most the cut;
missing values are the least of all and go left.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.operators.fitting import Packed, matrix, row_bytes
from pitchline.session import scratch_path

BINS = 256
FEW = 4 * BINS                 # estimated distinct values up to which they are counted exactly
FLAT = 4                       # depth up to which every cut of a tree is tried on all rows


def cut_points(rows: DataFrame, p: int, bins: int = BINS) -> tuple[list[list[float]], list[list[float]]]:
    """Upper values of the bins of each feature of ``rows`` (x), the last bin left
    out, and the middles to the next value: the distinct values where there are at
    most ``bins``, else approximate quantiles (their own middles).  At most p x
    bins numbers come to the driver."""
    x = [F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i))) for i in range(p)]
    about = rows.agg(*[F.approx_count_distinct(c) for c in x]).head()
    few = [i for i in range(p) if about[i] <= FEW]
    values: dict[int, list[float]] = {}
    if few:
        one = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), x[i].alias("v")) for i in few])).alias("c")
        for r in rows.select(one).select("c.*").where("v is not null").distinct().collect():      # about FEW values a feature
            values.setdefault(r["f"], []).append(r["v"])
    many = [i for i in range(p) if i not in few or len(values.get(i, [])) > bins]
    exact = [sorted(values.get(i, [])) for i in range(p)]
    upper, middle = [v[:-1] for v in exact], [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in exact]
    if many:
        at = [b / bins for b in range(1, bins)]
        r = rows.agg(*[F.percentile_approx(x[i], at, 50 * bins) for i in many]).head()
        for i, c in zip(many, r):
            upper[i] = middle[i] = sorted(set(c or []))
    return upper, middle


def binned(data: Packed, cuts: list[list[float]], extra: dict | None = None, drawn: Callable | None = None, parts: int = 0) -> tuple[DataFrame, str]:
    """``data`` with bins (``b``, bytes) for its features, written anew, and its path;
    ``extra``: more columns; ``drawn``: rows of small numbers for the ids, which
    column ``n`` holds as bytes; ``parts``: the least number of tasks."""
    p = len(data.features)
    rows = data.rows.select("id", "y", "w", "xb")
    if rows.rdd.getNumPartitions() < parts:
        rows = rows.repartition(parts, "id")

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("xb"), p)
            b = np.empty(x.shape, dtype=np.int16)
            for i in range(p):
                b[:, i] = np.searchsorted(cuts[i], x[:, i], side="left")
                b[np.isnan(x[:, i]), i] = 0
            out = [batch.column("id"), batch.column("y"), batch.column("w"), row_bytes(b)]
            if drawn:
                out.append(row_bytes(drawn(batch.column("id").to_numpy()).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays(out, names=["id", "y", "w", "b", "n"][:len(out)])

    path = scratch_path(data.rows.sparkSession, "binned")
    done = rows.mapInArrow(run, "id long, y int, w double, b binary" + (", n binary" if drawn else ""))
    done.withColumns(extra or {}).write.parquet(path)
    return data.rows.sparkSession.read.parquet(path), path


def walk(tree: dict, values: np.ndarray, cut: str, depth: int) -> np.ndarray:
    """Node that each row of ``values`` reaches in ``depth`` steps; ``cut`` names
    the tree's cuts for these values ("bin" or "value")."""
    feature, at = np.asarray(tree["feature"]), np.asarray(tree[cut])
    node, rows = np.zeros(len(values), dtype=np.int64), np.arange(len(values))
    for _ in range(depth):
        f = feature[node]
        right = values[rows, np.maximum(f, 0)] > at[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def reached(tree: dict, columns: np.ndarray, values, depth: int, node: int = 0):
    """``values`` of the node that each row reaches in ``depth`` steps, as
    ``walk`` by bins; ``columns`` has a line per feature.  One comparison per
    inner node over a whole line: shallow trees only."""
    f = tree["feature"][node]
    if f < 0 or not depth:
        return values[node]
    right = columns[f] > tree["bin"][node]
    return np.where(right, reached(tree, columns, values, depth - 1, 2 * node + 2), reached(tree, columns, values, depth - 1, 2 * node + 1))


def empty_tree(depth: int) -> dict:
    n = 2 ** (depth + 1) - 1
    return {"feature": [-1] * n, "bin": [0] * n, "value": [0.0] * n, "gain": [0.0] * n}


def best(gain: np.ndarray) -> tuple[int, int, float]:
    """(row, column) of the greatest gain, rounded so that equal gains tie; the
    first on ties."""
    g = np.round(np.where(np.isfinite(gain), gain, -1.0), 9)
    i, j = np.unravel_index(int(g.argmax()), g.shape)
    return int(i), int(j), float(g[i, j])
