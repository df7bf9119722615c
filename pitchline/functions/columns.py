"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# ---------------------------------------------------------------- fixed values
# Match-outcome codes and their label encoding (fixed values of the data model).
RESULT_HOME, RESULT_DRAW, RESULT_AWAY = "H", "D", "A"
LABEL_ENCODING = {"H": 0, "D": 1, "A": 2}
# Points for win / draw / loss.
POINTS_WIN, POINTS_DRAW, POINTS_LOSS = 3.0, 1.0, 0.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL condition counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col(num).cast("double"), F.nullif(col(den).cast("double"), F.lit(0.0)))


def points(goals_for, goals_against) -> Column:
    """3 / 1 / 0 by comparison; NULL when either side is missing."""
    gf, ga = col(goals_for), col(goals_against)
    return (F.when(gf > ga, F.lit(POINTS_WIN))
             .when(gf == ga, F.lit(POINTS_DRAW))
             .when(gf < ga, F.lit(POINTS_LOSS)))


def round6(c) -> Column:
    """Round half away from zero to 6 places with plain IEEE arithmetic (the
    same formula is used in the SQL oracle, so both engines produce identical
    bits), and fold -0.0 into 0.0.  Magnitudes >= 1e9 already carry fewer
    than 6 fractional digits of precision and pass through."""
    x = col(c).cast("double")
    r = F.signum(x) * F.floor(F.abs(x) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    return F.when(F.abs(x) < F.lit(1e9), r).otherwise(x) + F.lit(0.0)


# ---------------------------------------------------------------- history windows
def prior_rows(w: WindowSpec, k: int | None = None) -> WindowSpec:
    """Frame of the k previous rows (all previous rows when k is None)."""
    from pyspark.sql import Window
    return w.rowsBetween(Window.unboundedPreceding if k is None else -k, -1)


def _longest(specs) -> dict[str, int]:
    kmax: dict[str, int] = {}
    for x, k in specs:
        kmax[x] = max(kmax.get(x, 0), k)
    return kmax


def lag_name(x: str, j: int, prefix: str = "_lag") -> str:
    return f"{prefix}{j}_{x}"


def lag_columns(specs, w: WindowSpec, prefix: str = "_lag") -> list[Column]:
    """``lag(x, 1..k)`` columns for each (x, k); feed ``weighted_from_lags``."""
    return [F.lag(x, j).over(w).alias(lag_name(x, j, prefix)) for x, k in _longest(specs).items() for j in range(1, k + 1)]


def newer_count_columns(specs, prefix: str = "_lag") -> list[Column]:
    """For each x: ``{prefix}n{j}_x`` = number of non-null values among lags
    1..j.  Shared by every window length over the same x; keeps
    ``weighted_from_lags`` linear in k."""
    out = []
    for x, k in _longest(specs).items():
        run = F.lit(0)
        for j in range(1, k + 1):
            run = run + F.col(lag_name(x, j, prefix)).isNotNull().cast("int")
            out.append(run.alias(f"{prefix}n{j}_{x}"))
    return out


def weighted_from_lags(x: str, k: int, prefix: str = "_lag", weights: str = "suffix") -> Column:
    """Linearly weighted mean of the non-null values among the k previous rows.

    With n non-null values in the frame, oldest..newest get weights
    k-n+1 .. k ("suffix": the newest always weighs k) or 1 .. n ("restart"):
    the weight of lag j is the top weight minus the number of non-null lags
    newer than it, and the weights sum to a closed form of n.  NULL when
    n == 0.  Plain arithmetic over lag and count columns (``lag_columns``,
    ``newer_count_columns``): small generated code.
    """
    if weights not in ("suffix", "restart"):
        raise ValueError(f"unknown weights {weights!r}")
    newer = [F.lit(0), *[F.col(f"{prefix}n{j}_{x}") for j in range(1, k + 1)]]
    n = newer[k]
    top = F.lit(k) if weights == "suffix" else n
    num = F.lit(0.0)
    for j in range(1, k + 1):
        num = num + F.coalesce(F.col(lag_name(x, j, prefix)) * (top - newer[j - 1]).cast("double"), F.lit(0.0))
    den = (n * top).cast("double") - (n * (n - 1)).cast("double") / 2.0
    return F.when(n > 0, num / den)


def prior_std(x, k: int, w: WindowSpec, min_count: int = 2) -> Column:
    """Population std of the non-null values among the k previous rows."""
    frame = prior_rows(w, k)
    return F.when(F.count(col(x)).over(frame) >= min_count, F.stddev_pop(col(x)).over(frame))


def std_from_lags(x: str, k: int, mean: Column, prefix: str = "_lag", min_count: int = 2) -> Column:
    """``prior_std`` from lag and count columns: no frame is added up anew per row;
    ``mean`` is ``mean_from_lags`` as a column."""
    n = F.col(f"{prefix}n{k}_{x}")
    off = [F.col(lag_name(x, j, prefix)) - mean for j in range(1, k + 1)]
    total = F.lit(0.0)
    for o in off:
        total = total + F.coalesce(o * o, F.lit(0.0))
    return F.when(n >= min_count, F.sqrt(total / n))


def mean_from_lags(x: str, k: int, prefix: str = "_lag") -> Column:
    """Plain mean of the non-null values among the k previous rows."""
    total = F.lit(0.0)
    for j in range(1, k + 1):
        total = total + F.coalesce(F.col(lag_name(x, j, prefix)), F.lit(0.0))
    n = F.col(f"{prefix}n{k}_{x}")
    return F.when(n > 0, total / n)
