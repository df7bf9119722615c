"""The half-time training table the classifiers read (one row per match),
derived from ``matches``: identifier, half-time, target and feature column
groups named as in the reference's configuration."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.sources.tables import matches

# Column groups of the training table.
HALFTIME_COLUMNS = [
    "home_team_goal_count_half_time", "away_team_goal_count_half_time", "total_goals_at_half_time",
    "ht_result", "home_team_first_half_cards", "away_team_first_half_cards", "half_time_lead",
]
IDENTIFIER_COLUMNS = [
    "match_id", "timestamp", "date_GMT", "season", "status", "stadium_name", "referee",
    "home_team_name", "away_team_name", "Game Week",
]
TARGET_COLUMNS = [
    "target_match_result", "target_home_team_goal_count", "target_away_team_goal_count",
    "target_total_goal_count",
]
TARGET_COLUMN = "target_match_result"
# column order of ``halftime_table``
TABLE_COLUMNS = IDENTIFIER_COLUMNS + HALFTIME_COLUMNS + TARGET_COLUMNS + [
    "Pre-Match PPG (Home)", "Pre-Match PPG (Away)", "Home Team Pre-Match xG", "Away Team Pre-Match xG",
    "odds_move_home", "odds_move_away", "odds_move_abs_home", "implied_prob_shift_home",
    "travel_distance_km", "ppg_differential", "xg_power_index", "capacity", "home_xg_x10",
]
EXCLUDE_SEASONS = ["2025-2026"]


def halftime_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    mid = F.col("match_id")
    hth = F.when(F.col("home_goals").isNotNull(), F.least(F.col("home_goals"), mid % 3))
    hta = F.when(F.col("away_goals").isNotNull(), F.least(F.col("away_goals"), F.expr("match_id div 3") % 3))
    ts = F.timestamp_add("MINUTE", (mid % 96) * 15, F.col("kickoff"))
    return m.select(
        mid.alias("match_id"),
        # epoch seconds of the zone-less kickoff, independent of the session zone
        F.timestamp_diff("SECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), ts).alias("timestamp"),
        F.when(mid % 211 == 0, F.lit("TBD")).otherwise(F.date_format(ts, "MMM d yyyy - h:mma")).alias("date_GMT"),
        F.when(mid % 301 == 0, F.lit(None)).otherwise(F.col("season")).alias("season"),
        F.lit("complete").alias("status"),
        F.concat(F.lit("Stadium "), F.col("home_team")).alias("stadium_name"),
        F.concat(F.lit("Referee "), (mid % 40).cast("string")).alias("referee"),
        F.col("home_team").alias("home_team_name"),
        F.col("away_team").alias("away_team_name"),
        (F.weekofyear("kickoff")).alias("Game Week"),
        hth.alias("home_team_goal_count_half_time"),
        hta.alias("away_team_goal_count_half_time"),
        (hth + hta).alias("total_goals_at_half_time"),
        F.when(hth > hta, "H").when(hth == hta, "D").when(hth < hta, "A").alias("ht_result"),
        (mid % 4).alias("home_team_first_half_cards"),
        (F.expr("match_id div 4") % 4).alias("away_team_first_half_cards"),
        (hth - hta).alias("half_time_lead"),
        F.col("result").alias("target_match_result"),
        F.col("home_goals").alias("target_home_team_goal_count"),
        F.col("away_goals").alias("target_away_team_goal_count"),
        (F.col("home_goals") + F.col("away_goals")).alias("target_total_goal_count"),
        F.col("home_ppg").alias("Pre-Match PPG (Home)"),
        F.col("away_ppg").alias("Pre-Match PPG (Away)"),
        F.col("home_xg").alias("Home Team Pre-Match xG"),
        F.col("away_xg").alias("Away Team Pre-Match xG"),
        F.col("odds_move_home").alias("odds_move_home"),
        F.col("odds_move_away").alias("odds_move_away"),
        F.abs("odds_move_home").alias("odds_move_abs_home"),
        F.col("prob_shift_home").alias("implied_prob_shift_home"),
        F.col("travel_km").alias("travel_distance_km"),
        (F.col("home_ppg") - F.col("away_ppg")).alias("ppg_differential"),
        (F.col("home_xg") * 2.0 - F.col("away_xg")).alias("xg_power_index"),
        F.lit(1.0).alias("capacity"),
        (F.col("home_xg") * 10.0).alias("home_xg_x10"),
    )
