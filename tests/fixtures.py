"""Hand-made edge rows (first match, null goals, null odds inside a history,
two matches at one kickoff, a null team, a single-team league, ...)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

MATCH_SCHEMA = T.StructType([
    T.StructField("match_id", T.LongType()), T.StructField("kickoff", T.TimestampNTZType()),
    T.StructField("league_id", T.LongType()), T.StructField("season", T.StringType()),
    T.StructField("home_team", T.StringType()), T.StructField("away_team", T.StringType()),
    T.StructField("home_goals", T.LongType()), T.StructField("away_goals", T.LongType()),
    T.StructField("result", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in
      ["home_ppg", "away_ppg", "home_xg", "away_xg", "odds_move_home", "odds_move_away",
       "prob_shift_home", "prob_shift_away", "travel_km"]],
])


def d(day, hour=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=day, hours=hour)


def res(h, a):
    if h is None or a is None:
        return None
    return "H" if h > a else ("D" if h == a else "A")


def row(mid, day, home, away, hg, ag, odds_h=0.1, odds_a=-0.1, league=0, hour=0):
    return (mid, d(day, hour), league, "2019-2020", home, away, hg, ag, res(hg, ag),
            1.0 + mid % 3, 1.5, 1.2, 0.8 + (mid % 5) / 10, odds_h, odds_a, 0.01 * (mid % 4), -0.01, 37.5 * (mid % 3))


def edge_matches(spark):
    rows = [
        row(1, 0, "A", "B", 2, 1),
        row(2, 3, "B", "A", 1, 1, odds_h=None),          # null odds in a history
        row(3, 7, "A", "C", None, None),                 # null goals
        row(4, 7, "C", "B", 0, 3, hour=0),               # same kickoff as 3 for team C
        row(5, 10, "A", "B", 4, 0, odds_a=None),
        row(6, 14, "B", "C", 2, 2),
        row(7, 14, "C", "A", 1, 0),                      # C plays twice on day 14? no: B-C and C-A
        row(8, 20, "A", "B", 0, 1, odds_h=None, odds_a=None),
        row(9, 25, "A", "C", 3, 3),
        row(10, 30, "B", "A", 2, 0),
        row(11, 31, None, "A", 1, 0),                    # null home team
        row(12, 5, "S", "S2", 1, 0, league=1),           # another league
        row(13, 9, "S", "S2", 0, 0, league=1),
    ]
    return spark.createDataFrame(rows, MATCH_SCHEMA)
