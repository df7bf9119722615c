"""Exponentially weighted mean of a team's *previous* values.

Semantics (pandas ``ewm(span, adjust=False)`` over the shifted series, gaps
decaying): state ``(y, w)``; every slot multiplies ``w`` by
``beta = 1 - alpha``; an observation x sets ``y = (w*y + alpha*x)/(w + alpha)``
and ``w = 1``; the first observation sets ``y = x``.  The value for a row is
the state after all earlier rows of the team.

This is a true sequential recurrence, which Spark has no window function
for.  It runs as a ``mapInArrow`` scan over a frame that is hash
partitioned by team and sorted by (team, kickoff, match_id) -- the output of
the team window, so no extra exchange.  The scan streams Arrow batches and
keeps the state of one team only, the one that the batch ended with; the next
batch continues it (``_continued``).  Columns that the scan does not read pass
through as Arrow buffers.  Several columns are done in one pass; no group is
ever collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.operators.long_table import order_by


def _continued(y: float, g: int, x: np.ndarray, alpha: float, ignore_na: bool = False) -> np.ndarray:
    """State after each value of ``x`` when ``(y, g)`` came before: the mean
    ``y`` (NaN: nothing yet) and ``g`` null slots after its last observation."""
    beta, out = 1.0 - alpha, []
    for v in x.tolist():
        if v == v:
            if y != y:
                y = v
            else:
                c = beta if ignore_na or not g else beta ** (g + 1)
                y = (c * y + alpha * v) / (c + alpha)
            g = 0
        else:
            g += 1
        out.append(y)
    return np.array(out, dtype="float64")


def _after(y: float, g: int, x: np.ndarray, states: np.ndarray) -> tuple[float, int]:
    """The state that follows ``x``."""
    obs = np.flatnonzero(~np.isnan(x))
    if len(obs):
        return states[-1], len(x) - 1 - int(obs[-1])
    return (y, g) if math.isnan(y) else (y, g + len(x))


def _runs(batch: pa.RecordBatch, keys) -> Iterator[tuple[tuple, int, int]]:
    """(key, begin, end) of every run of rows with equal ``keys``, nulls equal."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = batch.column(k)
        for differs in (pc.not_equal(v[1:], v[:-1]), pc.not_equal(v[1:].is_null(), v[:-1].is_null())):
            new[1:] |= differs.fill_null(False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new).tolist()
    for i, j in zip(at, [*at[1:], batch.num_rows]):
        yield tuple(batch.column(k)[i].as_py() for k in keys), i, j


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as float64, null as NaN."""
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _scan(specs, span: float, keys, ignore_na: bool, seeded: bool = False):
    """Appends the state before every row; ``seeded``: the first row of a run
    tells the state that it starts with."""
    alpha = 2.0 / (span + 1.0)
    seeds = [f"_{p}0_{src}" for src, _ in specs for p in ("y", "g")] if seeded else []

    def run(batches):
        last, state = None, {}      # the key that the previous batch ended with, its state per column
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {src: _floats(batch, src) for src, _ in specs}
            seed = {c: _floats(batch, c) for c in seeds}
            res = {src: np.empty(batch.num_rows) for src, _ in specs}
            for key, i, j in _runs(batch, keys):
                if key != last:
                    last, state = key, {}
                    for src, _ in specs:
                        y, g = (seed[f"_y0_{src}"][i], seed[f"_g0_{src}"][i]) if seeded else (math.nan, 0)
                        state[src] = float(y), 0 if g != g else int(g)
                for src, _ in specs:
                    (y, g), mine = state[src], x[src][i:j]
                    states = _continued(y, g, mine, alpha, ignore_na)
                    res[src][i], res[src][i + 1:j] = y, states[:-1]     # a row's value: the state after the rows before it
                    state[src] = _after(y, g, mine, states)
            kept = [c for c in batch.schema.names if c not in seeds]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *[pa.array(res[src], from_pandas=True) for src, _ in specs]],
                                             names=[*kept, *[out for _, out in specs]])
    return run


def _in_order(df: DataFrame, keys, order) -> DataFrame:
    """All rows of a key in order in one partition.  The running number needs
    that, so the planner adds the exchange and sort for any input, and leaves
    them out after a window that has them already; a plain repartition after a
    join may be planned away and split by a local read."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_ewm_row", F.row_number().over(w)).where("_ewm_row > 0").drop("_ewm_row")


def with_prior_ewm(df: DataFrame, specs, span: float = 5, key: str = "team", ignore_na: bool = False) -> DataFrame:
    """Append ``out`` = EWM of the earlier ``src`` values of the same ``key``
    for each ``(src, out)`` in ``specs``.  Rows with a NULL key get NULL.
    ``ignore_na``: null slots do not decay."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType(), True) for _, out in specs])
    res = _in_order(df, [key], order_by()).mapInArrow(_scan(specs, span, [key], ignore_na), schema)
    return res.select(*df.columns, *[F.when(F.col(key).isNotNull(), F.col(out)).alias(out) for _, out in specs])


# ---------------------------------------------------------------- segmented form
# For keys whose history is split into bounded segments (operators/segments),
# the scan runs per segment in parallel.  A segment's effect on the state is
# affine in the incoming value: with R = the segment's EWM when it starts
# empty, x1 its first observation, n_lead the nulls before it and P the
# product of the decay factors of its later observations,
#     y_out = R + P * a1 * (y_in - x1),   a1 = c / (c + alpha),
#     c = beta ** (g_in + n_lead + 1)
# (g_in = null slots pending before the segment).  Pass A summarises each
# segment, pass B folds the small summary table per key to get every
# segment's incoming state, pass C scans the segments seeded with it.  All
# three stream rows in order; nothing is grouped in Python.

# x1, P and R are null where a segment has no observation; g_end then counts its rows
_SUMMARY_FIELDS = {"n_lead": T.LongType(), "x1": T.DoubleType(), "P": T.DoubleType(), "R": T.DoubleType(), "g_end": T.LongType()}


def _summarised(s: tuple, x: np.ndarray, alpha: float, ignore_na: bool) -> tuple:
    """The summary ``s`` of a segment so far, moved on over its next values."""
    beta = 1.0 - alpha
    lead, x1, P, R, g = s
    for v in x.tolist():
        if v == v:
            if x1 is None:
                lead, x1, P, R = g, v, 1.0, v
            else:
                c = beta if ignore_na or not g else beta ** (g + 1)
                P *= c / (c + alpha)
                R = (c * R + alpha * v) / (c + alpha)
            g = 0
        else:
            g += 1
    return lead, x1, P, R, g


def _segment_summary(specs, span: float, keys, ignore_na: bool, schema: pa.Schema):
    alpha = 2.0 / (span + 1.0)
    by = [*keys, "_seg"]

    def run(batches):
        last, now = None, {}
        for batch in batches:
            rows = []
            x = {src: _floats(batch, src) for src, _ in specs}
            for key, i, j in _runs(batch, by) if batch.num_rows else ():
                if key != last:
                    if last is not None:
                        rows.append((*last, *[v for src, _ in specs for v in now[src]]))
                    last, now = key, {src: (0, None, None, None, 0) for src, _ in specs}
                for src, _ in specs:
                    now[src] = _summarised(now[src], x[src][i:j], alpha, ignore_na)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if last is not None:
            row = (*last, *[v for src, _ in specs for v in now[src]])
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
    return run


def _incoming_states(specs, span: float, keys, ignore_na: bool, schema: pa.Schema):
    alpha = 2.0 / (span + 1.0)
    beta = 1.0 - alpha

    def run(batches):
        last, state = None, {}
        for batch in batches:
            rows = []
            fields = {src: list(zip(*[batch.column(f"{src}__{f}").to_pylist() for f in _SUMMARY_FIELDS])) for src, _ in specs}
            seg = batch.column("_seg").to_pylist()
            for key, i, j in _runs(batch, keys) if batch.num_rows else ():
                if key != last:
                    last, state = key, {src: (math.nan, 0) for src, _ in specs}
                for r in range(i, j):
                    rows.append((*key, seg[r], *[v for src, _ in specs for v in state[src]]))
                    for src, _ in specs:
                        (y, g), (n_lead, x1, P, R, g_end) = state[src], fields[src][r]
                        if x1 is None:
                            state[src] = (y, g) if math.isnan(y) else (y, g + g_end)
                            continue
                        if math.isnan(y):
                            y = R
                        else:
                            c = beta ** (1.0 if ignore_na else g + n_lead + 1.0)
                            y = R + P * (c / (c + alpha)) * (y - x1)
                        state[src] = y, g_end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def with_prior_ewm_segmented(seg_df: DataFrame, specs, span: float = 5, keys=("team",), ignore_na: bool = False) -> DataFrame:
    """``with_prior_ewm`` on segmented rows (columns ``_pos``, ``_seg``; halo
    rows already removed).  Exact: the three passes reproduce the full-history
    recurrence; a task streams its segments."""
    from pyspark.sql.pandas.types import to_arrow_schema
    keys = list(keys)
    by = [*keys, "_seg"]
    named = [T.StructField(k, seg_df.schema[k].dataType) for k in by]
    sums = T.StructType([*named, *[T.StructField(f"{src}__{f}", t) for src, _ in specs for f, t in _SUMMARY_FIELDS.items()]])
    before = T.StructType([*named, *[T.StructField(f"_{p}0_{src}", T.DoubleType() if p == "y" else T.LongType())
                                     for src, _ in specs for p in ("y", "g")]])
    summ = _in_order(seg_df.select(*by, "_pos", *[src for src, _ in specs]), by, ["_pos"]) \
        .mapInArrow(_segment_summary(specs, span, keys, ignore_na, to_arrow_schema(sums)), sums)
    states = _in_order(summ, keys, ["_seg"]).mapInArrow(_incoming_states(specs, span, keys, ignore_na, to_arrow_schema(before)), before)
    j = _in_order(seg_df.join(states, by, "left"), by, ["_pos"])   # one row of states per segment
    schema = T.StructType([f for f in j.schema.fields if f.name in seg_df.columns] + [T.StructField(out, T.DoubleType(), True) for _, out in specs])
    res = j.mapInArrow(_scan(specs, span, by, ignore_na, seeded=True), schema)
    return res.select(*seg_df.columns, *[F.when(F.col(keys[0]).isNotNull(), F.col(out)).alias(out) for _, out in specs])
