"""Momentum features on the long team-match table.

One window per team (``partitionBy(team)``) and one per team and venue
(``partitionBy(team, is_home)``) share a single exchange; the venue window
only adds a sort.  The four EWM columns use the exact observation fold of
``pitchline.operators.ewm``.  Every feature ends one row before the match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchline.functions.columns import lag_columns, mean_from_lags, newer_count_columns, std_from_lags, weighted_from_lags
from pitchline.operators.ewm import with_prior_ewm
from pitchline.operators.long_table import long_table, order_by
from pitchline.operators.regroup import to_match_rows
from pitchline.operators.segments import rows_per_segment

# Fixed values of the feature definitions.
FATIGUE_LAMBDA = 0.1
ELO_BASE = 1500.0
EWM_SPAN = 5

# (source column, window k, output) for the linearly weighted team means
TEAM_WEIGHTED = [
    ("points", 3, "form_pts_3"), ("points", 5, "form_pts_5"), ("points", 8, "form_pts_8"),
    ("goal_diff", 5, "goal_diff_5"), ("xg_diff_proxy", 5, "xg_diff_5_proxy"),
    ("odds_move_for", 3, "odds_move_for_mom_3"), ("odds_move_for", 5, "odds_move_for_mom_5"),
    ("odds_move_abs_for", 5, "odds_move_abs_for_mom_5"),
    ("prob_shift_for", 5, "implied_prob_shift_for_mom_5"),
    ("travel_km_team", 5, "travel_km_mom_5"),
    ("opp_adj_points", 5, "opp_adj_form_5"),
]
# (source column, output) for the exponential means (W9), span 5
TEAM_EWM = [
    ("odds_move_for", "odds_move_for_ewm_5"),
    ("prob_shift_for", "implied_prob_shift_for_ewm_5"),
    ("travel_km_team", "travel_km_ewm_5"),
    ("match_density", "match_density_ewm_5"),
]

LONG_FEATURES = [
    "form_pts_3", "form_pts_5", "form_pts_8", "goal_diff_5", "xg_diff_5_proxy",
    "mom_slope", "mom_volatility_5", "rest_days", "match_density", "fatigue_adjusted_form",
    "travel_km_team", "travel_fatigue_score",
    "odds_move_for_mom_3", "odds_move_for_mom_5", "odds_move_abs_for_mom_5",
    "implied_prob_shift_for_mom_5", "odds_move_for_ewm_5", "implied_prob_shift_for_ewm_5",
    "travel_km_mom_5", "travel_km_ewm_5", "match_density_mom_5", "match_density_ewm_5",
    "travel_fatigue_mom_5", "opp_adj_form_5", "opp_adj_form_5_elo",
    "venue_form_pts_5", "venue_xg_diff_5_proxy", "pre_match_elo",
]

# (difference column, feature) -> home_<feature> - away_<feature>
DIFF_PAIRS = [
    ("form_pts_diff_3", "form_pts_3"), ("form_pts_diff_5", "form_pts_5"),
    ("form_pts_diff_8", "form_pts_8"), ("goal_diff_mom_5_diff", "goal_diff_5"),
    ("xg_diff_mom_5_proxy_diff", "xg_diff_5_proxy"), ("mom_slope_diff", "mom_slope"),
    ("mom_volatility_diff", "mom_volatility_5"), ("rest_days_diff", "rest_days"),
    ("match_density_diff", "match_density"), ("fatigue_adjusted_form_diff", "fatigue_adjusted_form"),
    ("travel_km_team_diff", "travel_km_team"), ("travel_fatigue_score_diff", "travel_fatigue_score"),
    ("odds_move_for_mom_diff_3", "odds_move_for_mom_3"), ("odds_move_for_mom_diff_5", "odds_move_for_mom_5"),
    ("odds_move_abs_for_mom_diff_5", "odds_move_abs_for_mom_5"),
    ("implied_prob_shift_for_mom_diff_5", "implied_prob_shift_for_mom_5"),
    ("odds_move_for_ewm_diff_5", "odds_move_for_ewm_5"),
    ("implied_prob_shift_for_ewm_diff_5", "implied_prob_shift_for_ewm_5"),
    ("travel_km_mom_diff_5", "travel_km_mom_5"), ("travel_km_ewm_diff_5", "travel_km_ewm_5"),
    ("match_density_mom_diff_5", "match_density_mom_5"), ("match_density_ewm_diff_5", "match_density_ewm_5"),
    ("travel_fatigue_mom_diff_5", "travel_fatigue_mom_5"), ("opp_adj_form_diff_5", "opp_adj_form_5"),
    ("opp_adj_form_diff_5_elo", "opp_adj_form_5_elo"), ("venue_form_pts_5_diff", "venue_form_pts_5"),
    ("venue_xg_diff_5_proxy_diff", "venue_xg_diff_5_proxy"), ("elo_diff_pre_from_merge", "pre_match_elo"),
]


def team_window():
    return Window.partitionBy("team").orderBy(*order_by())


def _base(lt: DataFrame) -> DataFrame:
    has_elo = "opponent_pre_match_elo" in lt.columns
    return lt.select(
        "*",
        (F.col("points") * (F.col("opponent_ppg") / 3.0)).alias("opp_adj_points"),
        (F.col("points") * (1.0 / (1.0 + F.pow(F.lit(10.0), (F.lit(ELO_BASE) - F.col("opponent_pre_match_elo")) / 400.0)))
         if has_elo else F.lit(None).cast("double")).alias("opp_adj_points_elo"),
    )


# Longest look-back of the team features: 8 rows (form_pts_8); the windows
# over window results need 5 + 1.  Segment halos must cover it.
TEAM_HALO = 8
VENUE_HALO = 5


def _team_features(df: DataFrame, w, weights: str = "suffix") -> DataFrame:
    """Team-window features (everything but the venue ones) for window ``w``."""
    team_lags = [(src, k) for src, k, _ in TEAM_WEIGHTED] + [("opp_adj_points_elo", 5)]
    s1 = df.select(
        "*",
        *lag_columns(team_lags, w),
        (F.timestamp_diff("MICROSECOND", F.lag("kickoff").over(w), F.col("kickoff")) / 86400e6).alias("rest_days"),
    )
    density = F.when(F.col("rest_days").isNotNull(), 1.0 / F.greatest(F.col("rest_days"), F.lit(1.0)))
    s1 = s1.select("*", *newer_count_columns(team_lags))
    s1 = s1.select("*", mean_from_lags("goal_diff", 5).alias("_mean"))
    s2 = s1.select(
        *df.columns, std_from_lags("goal_diff", 5, F.col("_mean")).alias("mom_volatility_5"), "rest_days",      # the lags end here
        *[weighted_from_lags(src, k, weights=weights).alias(out) for src, k, out in TEAM_WEIGHTED],
        weighted_from_lags("opp_adj_points_elo", 5, weights=weights).alias("opp_adj_form_5_elo"),
        density.alias("match_density"),
    ).select(
        "*",
        (F.col("form_pts_3") - F.col("form_pts_5")).alias("mom_slope"),
        (F.col("form_pts_5") - FATIGUE_LAMBDA * F.col("match_density")).alias("fatigue_adjusted_form"),
        (F.col("match_density") + F.col("travel_km_team") / 1000.0).alias("travel_fatigue_score"),
    )
    # Windows over window results, same spec -> no new exchange or sort
    w16 = [("match_density", 5), ("travel_fatigue_score", 5)]
    s3 = s2.select("*", *lag_columns(w16, w))
    s3 = s3.select("*", *newer_count_columns(w16))
    return s3.select(
        *s2.columns,
        weighted_from_lags("match_density", 5, weights=weights).alias("match_density_mom_5"),
        weighted_from_lags("travel_fatigue_score", 5, weights=weights).alias("travel_fatigue_mom_5"),
    )


def _venue_features(df: DataFrame, wv, weights: str = "suffix") -> DataFrame:
    vl = [("points", 5), ("xg_diff_proxy", 5)]
    v = df.select("*", *lag_columns(vl, wv, prefix="_vlag"))
    v = v.select("*", *newer_count_columns(vl, prefix="_vlag"))
    return v.select(*df.columns, weighted_from_lags("points", 5, "_vlag", weights).alias("venue_form_pts_5"),
                    weighted_from_lags("xg_diff_proxy", 5, "_vlag", weights).alias("venue_xg_diff_5_proxy"))


def _windowed(lt: DataFrame, weights: str) -> DataFrame:
    """All window features on the plain team / team-venue windows."""
    w = team_window()
    wv = Window.partitionBy("team", "is_home").orderBy(*order_by())
    return _team_features(_venue_features(_base(lt), wv, weights), w, weights)


KEEP = ["match_id", "is_home", "team", "opponent", "kickoff", "league_id", "season"]
KEYS = ["match_id", "is_home", "team", "kickoff"]
VENUE_OUT = ["venue_form_pts_5", "venue_xg_diff_5_proxy"]
# what the team features read beside the keys
TEAM_SOURCES = list(dict.fromkeys([*[src for src, _, _ in TEAM_WEIGHTED], "opp_adj_points_elo", "pre_match_elo"]))


def _long_features_segmented(lt: DataFrame, seg_rows: int, weights: str, ignore_na: bool, keep: list[str]) -> DataFrame:
    """Skew-safe form: team features on (team, segment) windows with a halo
    of 8 rows, venue features on (team, is_home, segment) windows with a
    halo of 5, the EWM by the segmented exact scan; joined on the row key."""
    from pitchline.operators.ewm import with_prior_ewm_segmented
    from pitchline.operators.segments import segment, segment_window
    base = _base(lt)
    if "pre_match_elo" not in base.columns:
        base = base.withColumn("pre_match_elo", F.lit(None).cast("double"))
    # the positions are written: nothing goes along that is not read
    ts = segment(base.select(*keep, *TEAM_SOURCES), ["team"], seg_rows, TEAM_HALO)
    a = _team_features(ts, segment_window(["team"]), weights).where(~F.col("_halo"))
    ewm_out = {o for _, o in TEAM_EWM}
    ewm_src = [s for s, _ in TEAM_EWM if s not in LONG_FEATURES]
    main = a.select(*keep, "_pos", "_seg", *ewm_src,
                    *[c for c in LONG_FEATURES if c not in ewm_out and c not in VENUE_OUT])
    main = with_prior_ewm_segmented(main, TEAM_EWM, EWM_SPAN, ["team"], ignore_na)
    vs = segment(base.select("match_id", "team", "is_home", "kickoff", "points", "xg_diff_proxy"),
                 ["team", "is_home"], seg_rows, VENUE_HALO)
    venue = _venue_features(vs, segment_window(["team", "is_home"]), weights).where(~F.col("_halo")) \
        .select("match_id", "is_home", *VENUE_OUT)
    return main.join(venue, ["match_id", "is_home"]).select(*keep, *LONG_FEATURES)


def long_features(lt: DataFrame, seg_rows: int | None = None, weights: str = "suffix", ignore_na: bool = False, keep: list[str] = KEEP) -> DataFrame:
    """The momentum feature set, one row per (match, team), beside the columns
    ``keep``: at least ``KEYS``.  The Python scan hides from the planner which
    columns are read later, so a caller names no more than it needs.
    ``seg_rows``: see ``pitchline.operators.segments``; the result is the same.
    ``weights``: see ``weighted_from_lags``; ``ignore_na``: null slots do not
    decay the exponential means."""
    if seg_rows:
        return _long_features_segmented(lt, seg_rows, weights, ignore_na, keep)
    a = _windowed(lt, weights)
    if "pre_match_elo" not in a.columns:
        a = a.withColumn("pre_match_elo", F.lit(None).cast("double"))
    ewm_out = {o for _, o in TEAM_EWM}
    ewm_src = [s for s, _ in TEAM_EWM if s not in LONG_FEATURES]
    narrow = a.select(*keep, *ewm_src, *[c for c in LONG_FEATURES if c not in ewm_out])
    out = with_prior_ewm(narrow, TEAM_EWM, EWM_SPAN, ignore_na=ignore_na)
    return out.select(*keep, *LONG_FEATURES)


def match_features(m: DataFrame, seg_rows: int | None | str = "auto", weights: str = "suffix", ignore_na: bool = False, **elo_kw) -> DataFrame:
    """J1 + P24: per match, ``home_*`` and ``away_*`` momentum features and
    the 28 home-minus-away differences (NULL when either side is NULL).
    ``seg_rows``: as in ``venue_history``."""
    seg_rows = rows_per_segment(m) if seg_rows == "auto" else seg_rows
    from pitchline.operators.elo import with_elo
    lf = long_features(long_table(with_elo(m, **elo_kw)), seg_rows, weights, ignore_na, KEYS)
    wide = to_match_rows(lf, LONG_FEATURES)
    return wide.select(
        "*", *[(F.col(f"home_{f}") - F.col(f"away_{f}")).alias(d) for d, f in DIFF_PAIRS])
