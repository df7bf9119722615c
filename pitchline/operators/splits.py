"""Temporal splits (D1, D2) and the exact positional index they need.

``row_number()`` without ``partitionBy`` would pull every row into one task.
Instead the frame is sorted once (range-partitioned exchange: a hot kickoff
date is split across tasks because the order key continues with match_id),
each row keeps its partition id and partition-local index, and a tiny table
of per-partition counts (one row per partition: its size is bounded by the
partition count) turns them into global positions.  The indexed frame is
checkpointed to the shared checkpoint folder so the positions are computed
once and survive executor loss.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.operators.long_table import order_by

# Chronological split ratios.
TRAIN_RATIO, VAL_RATIO, TEST_RATIO = 0.7, 0.15, 0.15


def positional_index(df: DataFrame, order: list[Column] | None = None, out: str = "pos",
                     checkpoint: bool = True) -> DataFrame:
    """Add the 0-based position of every row in the total order ``order``."""
    order = order or order_by()
    s = df.orderBy(*order).select("*", F.spark_partition_id().alias("_pid"),
                                 F.monotonically_increasing_id().alias("_mid"))
    if checkpoint:
        s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1))).alias("_off"))
    # one row per partition: broadcasting it is bounded by the partition count
    j = s.join(F.broadcast(offs), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return j.select(*df.columns, (F.coalesce(F.col("_off"), F.lit(0)) + local).alias(out))


def time_split(df: DataFrame, order: list[Column] | None = None, train_ratio=TRAIN_RATIO,
               val_ratio=VAL_RATIO) -> DataFrame:
    """``split`` in {train, val, test} by position: the first
    int(n*train) rows, then up to int(n*(train+val)), then the rest."""
    p = positional_index(df, order)
    n = p.select(F.count(F.lit(1))).scalar()
    tr = F.floor(n.cast("double") * F.lit(train_ratio)).cast("long")
    va = F.floor(n.cast("double") * F.lit(train_ratio + val_ratio)).cast("long")
    return p.select("*", F.when(F.col("pos") < tr, "train").when(F.col("pos") < va, "val")
                    .otherwise("test").alias("split"))


def _before(keys: list[str], cut) -> Column:
    """Row key < ``cut``, column by column, NULL last."""
    out = F.lit(False)
    for k in reversed(keys):
        c, v = F.col(k), cut[k]
        if v is None:
            out = c.isNotNull() | (c.isNull() & out)
        else:
            out = F.coalesce(c < F.lit(v), F.lit(False)) | (F.coalesce(c == F.lit(v), F.lit(False)) & out)
    return out


AROUND = 0.005                 # share of the rows on both sides of a cut that are sorted


def keys_at(df: DataFrame, keys: list[str], n: int, positions: list[int]) -> list[dict | None]:
    """The keys (by name) at ``positions`` in the order of ``keys`` (NULL last), None past the
    end.  Where the first key is a time, only rows near the approximate quantile of
    a position are sorted, and a count says whether they hold it; otherwise, or where
    they do not, all keys are."""
    df, first = df.select(*keys), F.col(keys[0])
    order = [F.col(k).asc_nulls_last() for k in keys]
    out: dict[int, dict | None] = {a: None for a in positions if a >= n}
    if isinstance(df.schema[keys[0]].dataType, (T.DateType, T.TimestampType)):
        m = df.where(first.isNotNull()).count()
        want = [a for a in positions if a < m]
        at = [min(1.0, max(0.0, a / m + d)) for a in want for d in (-AROUND, AROUND)]
        found = df.agg(F.percentile_approx(first, at, 10_000)).head()[0] if at else []
        for i, a in enumerate(want):
            near = first.between(F.lit(found[2 * i]), F.lit(found[2 * i + 1]))
            before = df.where(first < F.lit(found[2 * i])).count()
            if before <= a:
                row = positional_index(df.where(near), order).where(F.col("pos") == a - before).head()
                if row is not None:
                    out[a] = {k: row[k] for k in keys}
    rest = [a for a in positions if a not in out]
    if rest:
        p = positional_index(df, order)
        out |= {r["pos"]: {k: r[k] for k in keys} for r in p.where(F.col("pos").isin(rest)).collect()}
    return [out.get(a) for a in positions]


def split_labels(df: DataFrame, keys: list[str], train_ratio=TRAIN_RATIO, val_ratio=VAL_RATIO) -> DataFrame:
    """D1 without positions: ``split`` by the order of ``keys`` (unique,
    ascending, NULL last).  The keys at the two cuts, two rows, come to the driver
    (``keys_at``) and the rows themselves are compared with them where they are."""
    n = df.count()
    at = [math.floor(n * train_ratio), math.floor(n * (train_ratio + val_ratio))]
    val, test = (F.lit(True) if cut is None else _before(keys, cut) for cut in keys_at(df, keys, n, at))
    return df.select("*", F.when(val, "train").when(test, "val").otherwise("test").alias("split"))


def before_cut(df: DataFrame, keys: list[str], share: float) -> Column:
    """Condition: among the first ``share`` of the rows in the order of ``keys``
    (unique, ascending, NULL last); the key at the cut comes to the driver."""
    p = positional_index(df.select(*keys), [F.col(k).asc_nulls_last() for k in keys], "pos")
    cut = p.where(F.col("pos") == math.floor(p.count() * share)).head()
    return F.lit(True) if cut is None else _before(keys, cut)


def walk_forward(df: DataFrame, n_splits: int = 5, order: list[Column] | None = None) -> DataFrame:
    """Expanding-window folds; fold = n // (k+1).  Row at position p is
    in the training part of every fold i >= p // fold and validates fold
    p // fold - 1; positions from k*fold+fold on are unused.  Returned in
    compact form (no row copies per fold): ``train_from_fold``, ``val_fold``
    (NULL when not used); ``fold_rows`` expands one fold when needed."""
    p = positional_index(df, order)
    n = p.select(F.count(F.lit(1))).scalar()
    fold = F.floor(n / F.lit(n_splits + 1)).cast("long")
    q = F.when(fold > 0, F.floor(F.col("pos") / fold)).cast("long")
    train_from = F.when(q < n_splits, q)
    val = F.when((q >= 1) & (q <= n_splits), q - 1)
    return p.select("*", fold.alias("fold_size"), train_from.alias("train_from_fold"), val.alias("val_fold"))


def fold_rows(folds: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation) frames of fold i from ``walk_forward`` output."""
    return (folds.where(F.col("train_from_fold") <= i), folds.where(F.col("val_fold") == i))


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact (interpolated) median of each column, as one row.

    The columns are unpivoted to (feature, value) and counted per distinct
    value (partial counts, so a value that fills a column costs one row per
    task); the distinct values are sorted once (a range exchange balances even
    a single dominant feature), and the values whose count range holds one of
    the two middle positions are averaged.  Memory per task stays bounded
    whatever the number of distinct values."""
    if not cols:
        return df.sparkSession.range(1).select()
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("v"))
                                          for i, c in enumerate(cols)])).alias("kv")).select("kv.*").where("v is not null")
    counts = long.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    s = counts.repartitionByRange("f", "v").sortWithinPartitions("f", "v").select(
        "*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("o")).checkpoint(eager=True)
    # rows before each (feature, partition): one row per pair, p x partitions at most
    part = s.groupBy("f", "p").agg(F.sum("n").alias("n")).select(
        "f", "p", F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("f")).alias("total"))
    run = F.sum("n").over(Window.partitionBy("f", "p").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    at = s.withColumn("upto", run).join(part, ["f", "p"])
    upto, low, high = F.col("before") + F.col("upto"), F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    holds = lambda k: (upto >= k) & (upto - F.col("n") < k)
    mid = at.where(holds(low) | holds(high)).groupBy("f").agg(F.avg("v").alias("median"))
    return mid.groupBy().agg(*[F.max(F.when(F.col("f") == i, F.col("median"))).alias(c) for i, c in enumerate(cols)])


def tail_rows(df: DataFrame, keys, n: int, order_desc: list[Column] | None = None) -> DataFrame:
    """T4: the last n rows of every group (``groupby(keys).tail(n)``);
    ``order_desc`` is the group order reversed."""
    order_desc = order_desc or [F.col("kickoff").desc_nulls_first(), F.col("match_id").desc()]
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_desc))
    return df.select("*", r.alias("_rk")).where(F.col("_rk") <= n).drop("_rk")
