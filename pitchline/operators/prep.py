"""Dataset preparation (P13-P19, A2-A4, A8, M3, M4): cleaning, column
selection by exclusion lists, label encoding, imputation, scaling, class
weights and split summaries.  Column lists are resolved from ``df.schema``
at plan time; statistics are one-row aggregates joined back (a single row:
its broadcast is bounded)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.functions.columns import LABEL_ENCODING
from pitchline.sources.training import (EXCLUDE_SEASONS, HALFTIME_COLUMNS, IDENTIFIER_COLUMNS,
                                        TARGET_COLUMN, TARGET_COLUMNS)

LABELS = ["H", "D", "A"]

# Feature subsets of ``clean_features``.
FEATURES_TO_DROP = [
    "ht_result_encoded",
    "odds_open_home", "odds_open_draw", "odds_open_away",
    "odds_close_home", "odds_close_draw", "odds_close_away",
    "implied_prob_open_home", "implied_prob_open_draw", "implied_prob_open_away",
    "implied_prob_close_home", "implied_prob_close_draw", "implied_prob_close_away",
    "odds_move_home", "odds_move_abs_home", "odds_move_draw", "odds_move_abs_draw",
    "odds_move_away", "odds_move_abs_away",
    "overround_open", "overround_close",
    "Home_longitude", "Away_longitude", "Away_longitude.1",
    "Home_latitude",
    "home_momentum_5_v2", "away_momentum_5_v2",
    "Home wins in the window", "Total home win rate", "Total home draw rate",
    "Total home loss rate", "Home goals forward", "Home goals against",
    "Home goal differential", "Home goals forward per match",
    "Home goals against per match", "Home goal differential per match",
    "_orig_idx", "_row_order",
]
CORE_FEATURES = [
    "half_time_lead",
    "home_team_goal_count_half_time",
    "away_team_goal_count_half_time",
    "total_goals_at_half_time",
    "home_team_first_half_cards",
    "away_team_first_half_cards",
    "odds_ft_home_team_win",
    "odds_ft_draw",
    "odds_ft_away_team_win",
    "odds_ft_over15",
    "odds_ft_over25",
    "odds_ft_over35",
    "Pre-Match PPG (Home)",
    "Pre-Match PPG (Away)",
    "home_ppg_momentum_5",
    "away_ppg_momentum_5",
    "Home Team Pre-Match xG",
    "Away Team Pre-Match xG",
    "average_goals_per_match_pre_match",
    "btts_percentage_pre_match",
    "over_15_percentage_pre_match",
    "over_25_percentage_pre_match",
    "over_35_percentage_pre_match",
    "over_15_HT_FHG_percentage_pre_match",
    "over_05_HT_FHG_percentage_pre_match",
    "over_15_2HG_percentage_pre_match",
    "average_corners_per_match_pre_match",
    "average_cards_per_match_pre_match",
    "home_match_density",
    "away_match_density",
    "home_recent_cards",
    "away_recent_cards",
    "home_recent_fouls",
    "away_recent_fouls",
    "ppg_differential",
    "xg_power_index",
    "travel_distance_km",
    "capacity",
]


def q(c: str):
    return F.col(f"`{c}`")


# ------------------------------------------------------------------ P1/P2 + P13/P14
def preprocess(df: DataFrame) -> DataFrame:
    """Parse ``date_GMT`` (fixed layout, bad -> NULL)."""
    from pitchline.functions.parse import parse_kickoff
    if "date_GMT" in df.columns:
        df = df.withColumn("date_GMT", parse_kickoff("date_GMT"))
    return df


def clean_data(df: DataFrame, exclude_seasons=EXCLUDE_SEASONS) -> DataFrame:
    """P13 + P14: drop rows without a target; drop excluded seasons but keep
    rows whose season is NULL."""
    df = df.where(F.col(TARGET_COLUMN).isNotNull())
    if "season" in df.columns:
        df = df.where(~F.coalesce(F.col("season").isin(*exclude_seasons), F.lit(False)))
    return df


def filter_seasons(df: DataFrame, seasons) -> DataFrame:
    """Keep listed seasons."""
    return df.where(F.col("season").isin(*seasons))


# ------------------------------------------------------------------ P16-P19
def prematch_feature_columns(df: DataFrame) -> list[str]:
    ex = set(HALFTIME_COLUMNS + IDENTIFIER_COLUMNS + TARGET_COLUMNS)
    return [c for c in df.columns if c not in ex]


def halftime_feature_columns(df: DataFrame) -> list[str]:
    ex = set(IDENTIFIER_COLUMNS + TARGET_COLUMNS)
    return [c for c in df.columns if c not in ex]


def numeric_columns(df: DataFrame, cols=None) -> list[str]:
    """Numeric columns only (booleans excluded)."""
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(types[c], T.NumericType)]


def encode_label(c) -> F.Column:
    """H -> 0, D -> 1, A -> 2; anything else -> NULL."""
    m = F.create_map(*[x for k, v in LABEL_ENCODING.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, F.col(c) if isinstance(c, str) else c)


def decode_label(c) -> F.Column:
    m = F.create_map(*[x for k, v in LABEL_ENCODING.items() for x in (F.lit(v), F.lit(k))])
    return F.try_element_at(m, F.col(c) if isinstance(c, str) else c)


def encode_ht_result(df: DataFrame) -> DataFrame:
    if "ht_result" in df.columns:
        df = df.withColumn("ht_result_encoded", encode_label("ht_result")).drop("ht_result")
    return df


def clean_features(df: DataFrame, mode: str = "conservative", keep=()) -> DataFrame:
    """``aggressive`` keeps the core list, ``conservative`` drops the drop
    list, ``minimal`` drops only the encoded half-time result."""
    if mode == "aggressive":
        cols = [c for c in CORE_FEATURES if c in df.columns]
    elif mode == "conservative":
        cols = [c for c in df.columns if c not in set(FEATURES_TO_DROP)]
    elif mode == "minimal":
        cols = [c for c in df.columns if c != "ht_result_encoded"]
    else:
        cols = list(df.columns)
    return df.select(*[q(c) for c in list(keep) + [c for c in cols if c not in keep]])


# ------------------------------------------------------------------ A4
def imputation_values(df: DataFrame, cols: list[str], strategy: str = "median") -> DataFrame:
    """One row of fill values per column (median exact, mean, or zero)."""
    if strategy == "median":
        from pitchline.operators.splits import exact_medians
        return exact_medians(df, cols)
    if strategy == "mean":
        return df.agg(*[F.avg(q(c)).alias(c) for c in cols])
    return df.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in cols])


def impute(df: DataFrame, cols: list[str], fill: DataFrame, keep=()) -> DataFrame:
    """``coalesce(x, fill, 0)`` per column, with the fill row from
    ``imputation_values`` (fit it on the training split)."""
    # the one-row side enters as a single scalar subquery (a struct of all
    # fill values): evaluated once, and the plan stays a plain projection
    if not cols:
        return df.select(*[q(k) for k in keep])
    row = fill.select(F.struct(*[q(c).cast("double").alias(f"f{i}") for i, c in enumerate(cols)])).scalar()
    return df.select(*[q(k) for k in keep],
                     *[F.coalesce(q(c).cast("double"), row.getField(f"f{i}"), F.lit(0.0)).alias(c)
                       for i, c in enumerate(cols)])


def handle_missing_values(df: DataFrame, strategy: str = "median", fit_on: DataFrame | None = None,
                          keep=()) -> DataFrame:
    """A4: numeric columns only, fill by strategy, then 0.  The fill values come
    from ``fit_on``: the training split for features of a model, so that
    nothing of later splits leaks; None takes them from ``df`` itself."""
    cols = [c for c in numeric_columns(df) if c not in keep]
    fill = imputation_values(fit_on if fit_on is not None else df, cols, strategy)
    return impute(df, cols, fill, keep)


def handle_missing_per_split(df: DataFrame, strategy: str = "median", split_col: str = "split",
                             splits=("train", "val", "test"), keep=()) -> DataFrame:
    """A4 as the reference's scripts do it: every split is filled from itself."""
    out = None
    for s in splits:
        part = handle_missing_values(df.where(q(split_col) == s).drop(split_col), strategy, keep=keep).withColumn(split_col, F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ M3 / M4
def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, keep=()) -> DataFrame:
    """M3: (x - mean) / population std (std 0 -> divide by 1, as a scaler does)."""
    src = fit_on if fit_on is not None else df
    stats = src.agg(F.struct(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                             *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)])).scalar()
    out = []
    for i, c in enumerate(cols):
        mu = stats.getField(f"m{i}")
        sd = stats.getField(f"s{i}")
        sd1 = F.when((sd.isNull()) | (sd == 0), F.lit(1.0)).otherwise(sd)
        out.append(((q(c) - mu) / sd1).alias(c))
    return df.select(*[q(k) for k in keep], *out)


def class_weights(df: DataFrame, label: str = TARGET_COLUMN) -> DataFrame:
    """M4: balanced weights n / (k * n_c) per class."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tk = c.select(F.struct(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return c.select(label, "n_c", (tk.getField("n") / (tk.getField("k") * F.col("n_c"))).alias("weight"))


# ------------------------------------------------------------------ A2 / A3 / A8
def value_counts(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """A2: counts of ``col`` within each ``by`` group."""
    return df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str = TARGET_COLUMN) -> DataFrame:
    """A3: normalised class frequencies (NULL labels ignored)."""
    d = df.where(F.col(label).isNotNull())
    tot = d.select(F.count(F.lit(1))).scalar()
    return d.groupBy(label).agg((F.count(F.lit(1)) / tot).alias("share"))


def season_distribution(df: DataFrame, label: str = TARGET_COLUMN) -> DataFrame:
    """A3 per season: H / D / A shares (0 when absent) and the row count, in
    one aggregation (a NULL season is a group of its own)."""
    n = F.count(F.lit(1))
    return df.groupBy("season").agg(*[(F.count_if(F.col(label) == x) / n).alias(x) for x in LABELS],
                                    n.alias("count"))


def split_ranges(df: DataFrame, time_col: str = "date_GMT") -> DataFrame:
    """First and last time and row count per split."""
    return df.groupBy("split").agg(F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time"),
                                   F.count(F.lit(1)).alias("rows"))
