"""Wide match table -> long team-match table (two rows per match).

One scan: every match row becomes an array of two side-oriented structs that
is exploded, so no self-union and no second read of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.functions.columns import RESULT_AWAY, RESULT_DRAW, RESULT_HOME, flag, points

# Order of a team's matches: kickoff (missing kickoffs last), then match_id.
ORDER_COLS = ("kickoff", "match_id")


def order_by() -> list[Column]:
    return [F.col("kickoff").asc_nulls_last(), F.col("match_id").asc()]


def match_columns(m: DataFrame) -> DataFrame:
    """Result flags, goals for/against/difference, margins, points."""
    r = F.col("result")
    hg, ag = F.col("home_goals").cast("double"), F.col("away_goals").cast("double")
    return m.select(
        "*",
        flag(r == RESULT_HOME).alias("home_win"),
        flag(r == RESULT_DRAW).alias("home_draw"),
        flag(r == RESULT_AWAY).alias("home_loss"),
        flag(r == RESULT_AWAY).alias("away_win"),
        flag(r == RESULT_DRAW).alias("away_draw"),
        flag(r == RESULT_HOME).alias("away_loss"),
        (hg - ag).alias("home_goal_diff"),
        (ag - hg).alias("away_goal_diff"),
        F.when(r == RESULT_HOME, hg - ag).alias("home_win_margin"),
        F.when(r == RESULT_AWAY, ag - hg).alias("away_win_margin"),
        F.when(r == RESULT_AWAY, ag - hg).alias("home_loss_margin"),
        F.when(r == RESULT_HOME, hg - ag).alias("away_loss_margin"),
        points(hg, ag).alias("home_points"),
        points(ag, hg).alias("away_points"),
    )


def _side(home: bool, with_elo: bool) -> Column:
    s, o = ("home", "away") if home else ("away", "home")
    fields = [
        F.col(f"{s}_team").alias("team"),
        F.col(f"{o}_team").alias("opponent"),
        F.lit(1 if home else 0).alias("is_home"),
        F.col(f"{s}_goals").cast("double").alias("goals_for"),
        F.col(f"{o}_goals").cast("double").alias("goals_against"),
        F.col(f"{s}_win").alias("win"),
        F.col(f"{s}_draw").alias("draw"),
        F.col(f"{s}_loss").alias("loss"),
        F.col(f"{s}_goal_diff").alias("goal_diff"),
        F.col(f"{s}_win_margin").alias("win_margin"),
        F.col(f"{s}_loss_margin").alias("loss_margin"),
        F.col(f"{s}_points").alias("points"),
        # Side-oriented market and strength columns
        ((F.col("home_xg") - F.col("away_xg")) * (1 if home else -1)).alias("xg_diff_proxy"),
        F.col(f"odds_move_{s}").alias("odds_move_for"),
        F.abs(F.col(f"odds_move_{s}")).alias("odds_move_abs_for"),
        F.col(f"prob_shift_{s}").alias("prob_shift_for"),
        (F.lit(0.0) if home else F.col("travel_km")).alias("travel_km_team"),
        F.col(f"{o}_ppg").alias("opponent_ppg"),
    ]
    if with_elo:
        fields += [F.col(f"{s}_elo_pre").alias("pre_match_elo"),
                   F.col(f"{o}_elo_pre").alias("opponent_pre_match_elo")]
    return F.struct(*fields)


def long_table(m: DataFrame) -> DataFrame:
    """Two rows per match, side-oriented.  A row with a NULL team is kept
    (so every match regroups) but never contributes to or receives history."""
    with_elo = "home_elo_pre" in m.columns
    mc = match_columns(m)
    return (mc.select("match_id", "kickoff", "league_id", "season", "result",
                      F.explode(F.array(_side(True, with_elo), _side(False, with_elo))).alias("s"))
              .select("match_id", "kickoff", "league_id", "season", "result", "s.*"))
