"""Strictly pre-match venue history (W1-W7): for each match, the home team's
record in its earlier *home* matches and the away team's record in its earlier
*away* matches.  All frames end one row before the current match.

Computed on the long table with one ``Window.partitionBy(team, is_home)``:
a single exchange and sort serve every feature, and the result is regrouped
to one row per match (bounded groups of two rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchline.functions.columns import prior_rows, safe_div
from pitchline.operators.long_table import long_table, order_by
from pitchline.operators.regroup import to_match_rows
from pitchline.operators.segments import rows_per_segment

VENUE_FEATURES = [
    "matches_before", "wins_last5", "win_rate", "draw_rate", "loss_rate",
    "goals_for", "goals_against", "goal_diff",
    "goals_for_pm", "goals_against_pm", "goal_diff_pm",
    "win_margin_avg", "loss_margin_avg",
]


def venue_history_long(lt: DataFrame, window: int = 5) -> DataFrame:
    """Per long row: the team's history at the same venue."""
    w = Window.partitionBy("team", "is_home").orderBy(*order_by())
    allp = prior_rows(w)
    lastk = prior_rows(w, window)
    n = (F.row_number().over(w) - 1)

    def cum(c):
        return F.coalesce(F.sum(c).over(allp), F.lit(0))

    out = lt.select(
        "match_id", "team", "is_home", "kickoff",
        n.alias("matches_before"),
        F.coalesce(F.sum("win").over(lastk), F.lit(0)).cast("double").alias("wins_last5"),
        cum("win").alias("_w"), cum("draw").alias("_d"), cum("loss").alias("_l"),
        F.coalesce(F.sum("goals_for").over(allp), F.lit(0.0)).alias("goals_for"),
        F.coalesce(F.sum("goals_against").over(allp), F.lit(0.0)).alias("goals_against"),
        F.coalesce(F.sum("goal_diff").over(allp), F.lit(0.0)).alias("goal_diff"),
        F.avg("win_margin").over(allp).alias("win_margin_avg"),
        F.avg("loss_margin").over(allp).alias("loss_margin_avg"),
    )
    n = F.col("matches_before")
    return out.select(
        "match_id", "team", "is_home", "kickoff", "matches_before", "wins_last5",
        safe_div("_w", n).alias("win_rate"),
        safe_div("_d", n).alias("draw_rate"),
        safe_div("_l", n).alias("loss_rate"),
        "goals_for", "goals_against", "goal_diff",
        safe_div("goals_for", n).alias("goals_for_pm"),
        safe_div("goals_against", n).alias("goals_against_pm"),
        safe_div("goal_diff", n).alias("goal_diff_pm"),
        "win_margin_avg", "loss_margin_avg",
    )


def venue_history_segmented(lt: DataFrame, seg_rows: int, window: int = 5) -> DataFrame:
    """``venue_history_long`` for skewed keys: bounded segments with a halo of
    ``window`` rows; cumulative totals continue from per-segment offsets."""
    from pitchline.operators.segments import segment, segment_offsets, segment_window
    keys = ["team", "is_home"]
    s = segment(lt.select("match_id", "team", "is_home", "kickoff", "win", "draw", "loss", "goals_for",
                          "goals_against", "goal_diff", "win_margin", "loss_margin"), keys, seg_rows, window)
    own = ~F.col("_halo")
    parts = {"w": F.col("win"), "d": F.col("draw"), "l": F.col("loss"), "gf": F.col("goals_for"),
             "ga": F.col("goals_against"), "gd": F.col("goal_diff"), "wm": F.col("win_margin"),
             "wmn": F.col("win_margin").isNotNull().cast("long"), "lm": F.col("loss_margin"),
             "lmn": F.col("loss_margin").isNotNull().cast("long")}
    offs = segment_offsets(s, keys, parts)
    w = segment_window(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def cum(name):
        return F.coalesce(F.sum(F.when(own, parts[name])).over(before), F.lit(0)) + F.col(f"_off_{name}")

    # null-safe: rows without a team are a key of their own, as in the plain window
    on = [s[k].eqNullSafe(offs[k]) for k in [*keys, "_seg"]]
    x = s.join(offs, on).drop(*[offs[k] for k in [*keys, "_seg"]]).select(
        "match_id", "team", "is_home", "kickoff", "_halo", F.col("_pos").alias("matches_before"),
        F.coalesce(F.sum("win").over(w.rowsBetween(-window, -1)), F.lit(0)).cast("double").alias("wins_last5"),
        *[cum(n).alias(f"_{n}") for n in parts])
    n = F.col("matches_before")
    return x.where(~F.col("_halo")).select(
        "match_id", "team", "is_home", "kickoff", "matches_before", "wins_last5",
        safe_div("_w", n).alias("win_rate"), safe_div("_d", n).alias("draw_rate"),
        safe_div("_l", n).alias("loss_rate"),
        F.col("_gf").cast("double").alias("goals_for"), F.col("_ga").cast("double").alias("goals_against"),
        F.col("_gd").cast("double").alias("goal_diff"),
        safe_div("_gf", n).alias("goals_for_pm"), safe_div("_ga", n).alias("goals_against_pm"),
        safe_div("_gd", n).alias("goal_diff_pm"),
        safe_div("_wm", "_wmn").alias("win_margin_avg"), safe_div("_lm", "_lmn").alias("loss_margin_avg"))


def venue_history(m: DataFrame, window: int = 5, seg_rows: int | None | str = "auto") -> DataFrame:
    """One row per match with ``home_*`` and ``away_*`` venue features.
    ``seg_rows``: split team histories into segments of so many rows (see
    ``pitchline.operators.segments``), None: never, "auto": where a team has
    more than ``SEG_ROWS`` matches; the result is the same."""
    seg_rows = rows_per_segment(m) if seg_rows == "auto" else seg_rows
    lt = long_table(m)
    vl = venue_history_segmented(lt, seg_rows, window) if seg_rows else venue_history_long(lt, window)
    return to_match_rows(vl, VENUE_FEATURES)
