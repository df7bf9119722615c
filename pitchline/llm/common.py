"""Helpers shared by the operators: scratch tables, clash-free columns,
global positions, word counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchline.session import ensure_checkpoint_dir, remove_scratch, scratch_path, ship_package

# A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = 2000              # texts that a Python worker gets at a time


def prepare(spark) -> None:
    """What queries and pipeline stages need of a session: the checkpoint folder,
    the package on executors, and Arrow batches of at most ``BATCH_ROWS`` rows
    (whole texts are large; a session that asks for less is left alone)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def col(name: str) -> Column:
    """Column by literal name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add (any letter case)."""
    drop = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in drop])


def _texts(value) -> set[str]:
    if isinstance(value, str):
        return {value}
    return set().union(*map(_texts, value)) if isinstance(value, (list, tuple)) else set()


def shielded(*reads: str) -> Callable:
    """Decorator of an operator on a table (its first argument): columns that the
    operator neither reads (``reads`` and the names among its arguments) nor adds
    pass through under names of their own, so that no internal column can meet
    one of the user's.  A column named like one that is added is replaced."""

    def decorate(fn):
        @wraps(fn)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            bound = signature(fn).bind(docs, *args, **kwargs)
            bound.apply_defaults()
            known = set(reads).union(*[_texts(v) for v in bound.arguments.values()])
            away = {c: f"user column {i}" for i, c in enumerate(docs.columns) if c not in known}
            back = {v: k for k, v in away.items()}
            out = fn(docs.select(*[col(c).alias(away.get(c, c)) for c in docs.columns]), *args, **kwargs)
            made = {c.lower() for c in out.columns if c not in back}
            return out.select(*[col(c).alias(back.get(c, c)) for c in out.columns if c not in back or back[c].lower() not in made])
        return run
    return decorate


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with more marks before it if ``df`` has such a column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: the
    lineage is cut, and a lost executor rereads files instead of recomputing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_table = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove ``stored`` tables that nothing reads any more."""
    for t in tables:
        remove_scratch(t.sparkSession, t.scratch_table)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_position(df: DataFrame, order: Sequence[Column], pos: str, name: str = "sorted") -> tuple[DataFrame, int]:
    """Rows in the global order of ``order`` with a gapless position from 0,
    and the number of rows.

    One range exchange sorts the rows; each written row keeps its partition
    number and its index there (``monotonically_increasing_id``).  The counts
    per partition, one row each, turn them into positions.  No task or driver
    sees more than one range partition, and nothing is ordered in one task.
    """
    kept = df.columns
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    done = stored(ranged.withColumn("__mid", F.monotonically_increasing_id()), name)
    pid = F.shiftright("__mid", 33)
    # one row per range partition: bounded by the number of partitions
    counts = {r["p"]: r["n"] for r in done.select(pid.alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    start, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        start.append(total)
        total += counts.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(s).cast("long") for s in start or [0]]), (pid + 1).cast("int"))
    out = done.select(*[col(c) for c in kept],
                      (offset + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))).alias(pos))
    return out, total


def running_total_before(value: Column, by: Sequence[Column], order: Sequence[Column]) -> Column:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.sum(value).over(w) - value


BROADCAST_ROWS = 500_000       # rows of a few numbers that may be broadcast (about 16 MB)


def lookup_join(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join of wide rows with a table of keys, nulls equal.  The
    keys are written and counted: few are broadcast, so that the wide rows stay
    where they are; beyond ``BROADCAST_ROWS`` both sides are shuffled."""
    keys = stored(keys.select(*on), "lookup")
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = keys.select(*[F.col(c).alias(f"{c}_r") for c in on])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return df.join(F.broadcast(right) if few else right, match, how)
