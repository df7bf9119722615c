"""DuckDB SQL formulations of the registered queries.

These are written independently of the Spark plans (plain window frames,
lists, recursive CTEs) and serve as the correctness oracle at sf0.01.
"""

from __future__ import annotations

from pitchline.plans.common import d10, i64, r6
from pitchline.sources.tables import MATCHES_SQL

M = f"m AS ({MATCHES_SQL})"

# long table: one row per (match, side)
LONG_SQL = """
l AS (
  SELECT match_id, kickoff, home_team AS team, away_team AS opponent, 1 AS is_home,
    CASE WHEN result = 'H' THEN 1 ELSE 0 END AS win,
    CASE WHEN result = 'D' THEN 1 ELSE 0 END AS draw,
    CASE WHEN result = 'A' THEN 1 ELSE 0 END AS loss,
    CAST(home_goals AS DOUBLE) AS gf, CAST(away_goals AS DOUBLE) AS ga,
    CAST(home_goals AS DOUBLE) - CAST(away_goals AS DOUBLE) AS gd,
    CASE WHEN result = 'H' THEN CAST(home_goals - away_goals AS DOUBLE) END AS win_margin,
    CASE WHEN result = 'A' THEN CAST(away_goals - home_goals AS DOUBLE) END AS loss_margin,
    CASE WHEN home_goals > away_goals THEN 3.0E0 WHEN home_goals = away_goals THEN 1.0E0
         WHEN home_goals < away_goals THEN 0.0E0 END AS points,
    home_xg - away_xg AS xg_diff_proxy,
    odds_move_home AS odds_move_for, abs(odds_move_home) AS odds_move_abs_for,
    prob_shift_home AS prob_shift_for, 0.0E0 AS travel_km_team, away_ppg AS opponent_ppg
  FROM m
  UNION ALL
  SELECT match_id, kickoff, away_team, home_team, 0,
    CASE WHEN result = 'A' THEN 1 ELSE 0 END,
    CASE WHEN result = 'D' THEN 1 ELSE 0 END,
    CASE WHEN result = 'H' THEN 1 ELSE 0 END,
    CAST(away_goals AS DOUBLE), CAST(home_goals AS DOUBLE),
    CAST(away_goals AS DOUBLE) - CAST(home_goals AS DOUBLE),
    CASE WHEN result = 'A' THEN CAST(away_goals - home_goals AS DOUBLE) END,
    CASE WHEN result = 'H' THEN CAST(home_goals - away_goals AS DOUBLE) END,
    CASE WHEN away_goals > home_goals THEN 3.0E0 WHEN away_goals = home_goals THEN 1.0E0
         WHEN away_goals < home_goals THEN 0.0E0 END,
    away_xg - home_xg,
    odds_move_away, abs(odds_move_away), prob_shift_away, travel_km, home_ppg
  FROM m
)"""

VENUE_FEATURES = [
    "matches_before", "wins_last5", "win_rate", "draw_rate", "loss_rate",
    "goals_for", "goals_against", "goal_diff",
    "goals_for_pm", "goals_against_pm", "goal_diff_pm",
    "win_margin_avg", "loss_margin_avg",
]


def _frame(part: str, lo: str) -> str:
    return (f"(PARTITION BY {part} ORDER BY kickoff ASC NULLS LAST, match_id "
            f"ROWS BETWEEN {lo} PRECEDING AND 1 PRECEDING)")


def _venue_ctes() -> str:
    allp = _frame("team, is_home", "UNBOUNDED")
    last5 = _frame("team, is_home", "5")
    return VENUE_CTES.format(allp=allp, last5=last5)


def venue_history_sql(final: str = "", close: str = "", cols=None) -> str:
    allp = _frame("team, is_home", "UNBOUNDED")
    last5 = _frame("team, is_home", "5")
    v = f"""
v AS (
  SELECT match_id, is_home,
    count(*) OVER {allp} AS matches_before,
    coalesce(sum(win) OVER {last5}, 0) AS wins_last5,
    sum(win) OVER {allp} AS w, sum(draw) OVER {allp} AS d, sum(loss) OVER {allp} AS lo,
    coalesce(sum(gf) OVER {allp}, 0) AS goals_for,
    coalesce(sum(ga) OVER {allp}, 0) AS goals_against,
    coalesce(sum(gd) OVER {allp}, 0) AS goal_diff,
    avg(win_margin) OVER {allp} AS win_margin_avg,
    avg(loss_margin) OVER {allp} AS loss_margin_avg
  FROM l),
f AS (
  SELECT match_id, is_home, matches_before, wins_last5,
    CAST(w AS DOUBLE) / NULLIF(matches_before, 0) AS win_rate,
    CAST(d AS DOUBLE) / NULLIF(matches_before, 0) AS draw_rate,
    CAST(lo AS DOUBLE) / NULLIF(matches_before, 0) AS loss_rate,
    goals_for, goals_against, goal_diff,
    goals_for / NULLIF(matches_before, 0) AS goals_for_pm,
    goals_against / NULLIF(matches_before, 0) AS goals_against_pm,
    goal_diff / NULLIF(matches_before, 0) AS goal_diff_pm,
    win_margin_avg, loss_margin_avg
  FROM v)"""
    sel = ["match_id"]
    for side, flag in (("home", 1), ("away", 0)):
        for c in (cols or VENUE_FEATURES):
            e = f"max(CASE WHEN is_home = {flag} THEN {c} END)"
            sel.append(i64(e, f"{side}_{c}") if c == "matches_before" else r6(e, f"{side}_{c}"))
    return f"WITH {M}, {LONG_SQL}, {v}\n{final or 'SELECT'} {', '.join(sel)} FROM f GROUP BY match_id{close}"


# ------------------------------------------------------------------ Elo (G1)
ELO_SQL = """
eo AS (
  SELECT league_id, match_id, home_team, away_team,
    CAST(home_goals AS DOUBLE) AS hg, CAST(away_goals AS DOUBLE) AS ag,
    row_number() OVER (PARTITION BY league_id ORDER BY kickoff ASC NULLS LAST, match_id) AS rn
  FROM m),
er(league_id, rn, match_id, he, ae, ratings) AS (
  SELECT league_id, rn, match_id, he, ae,
    MAP([home_team, away_team], [he + 20.0E0 * (s - ex), ae + 20.0E0 * ((1.0E0 - s) - (1.0E0 - ex))])
  FROM (SELECT *, 1500.0E0 AS he, 1500.0E0 AS ae,
          1.0E0 / (1.0E0 + pow(10.0E0, (1500.0E0 - (1500.0E0 + 65.0E0)) / 400.0E0)) AS ex,
          CASE WHEN hg > ag THEN 1.0E0 WHEN hg = ag THEN 0.5E0 ELSE 0.0E0 END AS s
        FROM eo WHERE rn = 1)
  UNION ALL
  SELECT league_id, rn, match_id, he, ae,
    map_concat(ratings, MAP([home_team, away_team], [he + 20.0E0 * (s - ex), ae + 20.0E0 * ((1.0E0 - s) - (1.0E0 - ex))]))
  FROM (SELECT o.league_id, o.rn, o.match_id, o.home_team, o.away_team, r.ratings,
          coalesce(r.ratings[o.home_team], 1500.0E0) AS he, coalesce(r.ratings[o.away_team], 1500.0E0) AS ae,
          1.0E0 / (1.0E0 + pow(10.0E0, (coalesce(r.ratings[o.away_team], 1500.0E0)
                   - (coalesce(r.ratings[o.home_team], 1500.0E0) + 65.0E0)) / 400.0E0)) AS ex,
          CASE WHEN o.hg > o.ag THEN 1.0E0 WHEN o.hg = o.ag THEN 0.5E0 ELSE 0.0E0 END AS s
        FROM er r JOIN eo o ON o.league_id = r.league_id AND o.rn = r.rn + 1)
),
e AS (
  SELECT match_id, he AS home_elo_pre, ae AS away_elo_pre, he - ae AS elo_diff_pre,
    1.0E0 / (1.0E0 + pow(10.0E0, (ae - (he + 65.0E0)) / 400.0E0)) AS elo_home_win_prob_pre
  FROM er)"""


def elo_sql() -> str:
    cols = ", ".join(r6(c, c) for c in ["home_elo_pre", "away_elo_pre", "elo_diff_pre", "elo_home_win_prob_pre"])
    return f"WITH RECURSIVE {M}, {ELO_SQL}\nSELECT match_id, {cols} FROM e"


# ------------------------------------------------------------------ momentum
def _w(part: str = "team") -> str:
    return f"PARTITION BY {part} ORDER BY kickoff ASC NULLS LAST, match_id"


def _list(x: str, k: int, part: str = "team") -> str:
    return (f"list_filter(list({x}) OVER ({_w(part)} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), "
            f"lambda v: v IS NOT NULL)")


def _wavg(lst: str, k: int) -> str:
    return (f"CASE WHEN len({lst}) > 0 THEN list_sum(list_transform({lst}, lambda v, i: v * ({k} - len({lst}) + i))) "
            f"/ list_sum(list_transform({lst}, lambda v, i: CAST({k} - len({lst}) + i AS DOUBLE))) END")


WAVG_SPECS = [
    ("points", 3, "form_pts_3", "team"), ("points", 5, "form_pts_5", "team"),
    ("points", 8, "form_pts_8", "team"), ("gd", 5, "goal_diff_5", "team"),
    ("xg_diff_proxy", 5, "xg_diff_5_proxy", "team"),
    ("odds_move_for", 3, "odds_move_for_mom_3", "team"), ("odds_move_for", 5, "odds_move_for_mom_5", "team"),
    ("odds_move_abs_for", 5, "odds_move_abs_for_mom_5", "team"),
    ("prob_shift_for", 5, "implied_prob_shift_for_mom_5", "team"),
    ("travel_km_team", 5, "travel_km_mom_5", "team"),
    ("opp_adj_points", 5, "opp_adj_form_5", "team"),
    ("opp_adj_points_elo", 5, "opp_adj_form_5_elo", "team"),
    ("points", 5, "venue_form_pts_5", "team, is_home"),
    ("xg_diff_proxy", 5, "venue_xg_diff_5_proxy", "team, is_home"),
]
EWM_SPECS = [("odds_move_for", "odds_move_for_ewm_5"), ("prob_shift_for", "implied_prob_shift_for_ewm_5"),
             ("travel_km_team", "travel_km_ewm_5"), ("match_density", "match_density_ewm_5")]

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


def _ewm_rec() -> str:
    """Recursive CTE carrying (y, w) per EWM column along each team's rows."""
    a, b = 2.0 / 6.0, 1.0 - 2.0 / 6.0
    n = len(EWM_SPECS)
    init = ", ".join([f"x{i} AS y{i}" for i in range(n)] + [f"1.0E0 AS w{i}" for i in range(n)])
    ys_step, ws_step = [], []
    for i in range(n):
        y, w, x = f"r.y{i}", f"r.w{i}", f"t.x{i}"
        ys_step.append(
            f"CASE WHEN {y} IS NULL THEN {x} WHEN {x} IS NULL THEN {y} "
            f"ELSE ({w} * {b!r} * {y} + {a!r} * {x}) / ({w} * {b!r} + {a!r}) END AS y{i}")
        ws_step.append(
            f"CASE WHEN {y} IS NULL THEN 1.0E0 WHEN {x} IS NULL THEN {w} * {b!r} ELSE 1.0E0 END AS w{i}")
    step = ys_step + ws_step
    xs = ", ".join(f"{src} AS x{i}" for i, (src, _) in enumerate(EWM_SPECS))
    ys = ", ".join(f"y{i}" for i in range(len(EWM_SPECS)))
    ws = ", ".join(f"w{i}" for i in range(len(EWM_SPECS)))
    return f"""
et AS (SELECT team, match_id, is_home, row_number() OVER ({_w()}) AS rn, {xs} FROM s2),
ew(team, rn, {ys}, {ws}) AS (
  SELECT team, rn, {init} FROM et WHERE rn = 1
  UNION ALL
  SELECT t.team, t.rn, {', '.join(step)}
  FROM ew r JOIN et t ON t.team = r.team AND t.rn = r.rn + 1)"""


def long_features_body() -> str:
    lists = []
    for src, k, out, part in WAVG_SPECS:
        lists.append(f"{_list(src, k, part)} AS L_{out}")
    f5 = f"({_w()} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    s1_w = ",\n    ".join(f"{_wavg('L_' + out, k)} AS {out}" for _, k, out, _ in WAVG_SPECS)
    ewm_cols = ", ".join(f"lag(ew.y{i}) OVER (PARTITION BY et.team ORDER BY et.rn) AS {out}"
                         for i, (_, out) in enumerate(EWM_SPECS))
    return f"""
le AS (
  SELECT l.*, CASE WHEN is_home = 1 THEN e.home_elo_pre ELSE e.away_elo_pre END AS pre_match_elo,
    CASE WHEN is_home = 1 THEN e.away_elo_pre ELSE e.home_elo_pre END AS opp_elo
  FROM l JOIN e USING (match_id)),
b AS (
  SELECT *, points * (opponent_ppg / 3.0E0) AS opp_adj_points,
    points * (1.0E0 / (1.0E0 + pow(10.0E0, (1500.0E0 - opp_elo) / 400.0E0))) AS opp_adj_points_elo
  FROM le),
s0 AS (
  SELECT *, {', '.join(lists)},
    CASE WHEN count(gd) OVER {f5} >= 2 THEN stddev_pop(gd) OVER {f5} END AS mom_volatility_5,
    (epoch_us(kickoff) - epoch_us(lag(kickoff) OVER ({_w()}))) / 86400e6 AS rest_days
  FROM b),
s1 AS (
  SELECT *, {s1_w}
  FROM s0),
s2 AS (
  SELECT *, form_pts_3 - form_pts_5 AS mom_slope,
    CASE WHEN rest_days IS NOT NULL THEN 1.0E0 / greatest(rest_days, 1.0E0) END AS match_density
  FROM s1),
s3 AS (
  SELECT *, form_pts_5 - 0.1E0 * match_density AS fatigue_adjusted_form,
    match_density + travel_km_team / 1000.0E0 AS travel_fatigue_score
  FROM s2),
s4 AS (
  SELECT *, {_wavg(_list('match_density', 5), 5)} AS match_density_mom_5,
    {_wavg(_list('travel_fatigue_score', 5), 5)} AS travel_fatigue_mom_5
  FROM s3),
{_ewm_rec().strip()},
s5 AS (
  SELECT et.match_id, et.is_home, {ewm_cols}
  FROM et JOIN ew ON ew.team = et.team AND ew.rn = et.rn)"""


def long_features_sql(cols=None) -> str:
    sel = ["s4.match_id", "s4.is_home", "s4.team"]
    sel += [r6(f, f) for f in (cols or LONG_FEATURES)]
    return (f"WITH RECURSIVE {M}, {LONG_SQL}, {ELO_SQL}, {long_features_body()}\n"
            f"SELECT {', '.join(sel)} FROM s4 JOIN s5 USING (match_id, is_home)")


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


def match_diffs_sql() -> str:
    return match_features_sql(diffs_only=True)


def match_features_sql(diffs_only: bool = False) -> str:
    lf = (f"lf AS (SELECT s4.match_id, s4.is_home, {', '.join('s4.' + f if f not in dict(EWM_SPECS).values() else 's5.' + f for f in LONG_FEATURES)} "
          f"FROM s4 JOIN s5 USING (match_id, is_home))")
    wide = ", ".join(f"max(CASE WHEN is_home = {v} THEN {f} END) AS {side}_{f}"
                     for side, v in (("home", 1), ("away", 0)) for f in LONG_FEATURES)
    sel = ["match_id"] + ([] if diffs_only else
                          [r6(f"{side}_{f}", f"{side}_{f}") for side in ("home", "away") for f in LONG_FEATURES])
    sel += [r6(f"home_{f} - away_{f}", d) for d, f in DIFF_PAIRS]
    return (f"WITH RECURSIVE {M}, {LONG_SQL}, {ELO_SQL}, {long_features_body()}, {lf},\n"
            f"w AS (SELECT match_id, {wide} FROM lf GROUP BY match_id)\n"
            f"SELECT {', '.join(sel)} FROM w")


# ------------------------------------------------------------------ base columns, long table
def match_flags_sql() -> str:
    sel = ["match_id",
           i64("CASE WHEN result = 'H' THEN 1 ELSE 0 END", "home_win"),
           i64("CASE WHEN result = 'D' THEN 1 ELSE 0 END", "home_draw"),
           i64("CASE WHEN result = 'A' THEN 1 ELSE 0 END", "home_loss"),
           i64("CASE WHEN result = 'A' THEN 1 ELSE 0 END", "away_win"),
           i64("CASE WHEN result = 'D' THEN 1 ELSE 0 END", "away_draw"),
           i64("CASE WHEN result = 'H' THEN 1 ELSE 0 END", "away_loss"),
           r6("home_goals - away_goals", "home_goal_diff"), r6("away_goals - home_goals", "away_goal_diff"),
           r6("CASE WHEN result = 'H' THEN home_goals - away_goals END", "home_win_margin"),
           r6("CASE WHEN result = 'A' THEN away_goals - home_goals END", "away_win_margin"),
           r6("CASE WHEN result = 'A' THEN away_goals - home_goals END", "home_loss_margin"),
           r6("CASE WHEN result = 'H' THEN home_goals - away_goals END", "away_loss_margin")]
    return f"WITH {M} SELECT {', '.join(sel)} FROM m"


def match_points_sql() -> str:
    hp = ("CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 "
          "WHEN home_goals < away_goals THEN 0 END")
    ap = ("CASE WHEN away_goals > home_goals THEN 3 WHEN away_goals = home_goals THEN 1 "
          "WHEN away_goals < home_goals THEN 0 END")
    return f"WITH {M} SELECT match_id, {r6(hp, 'home_points')}, {r6(ap, 'away_points')} FROM m"


def long_table_sql() -> str:
    sel = ["match_id", "team", "opponent", i64("is_home", "is_home"), r6("gf", "goals_for"),
           r6("ga", "goals_against"), r6("points", "points"), r6("gd", "goal_diff"),
           r6("xg_diff_proxy", "xg_diff_proxy"), r6("odds_move_for", "odds_move_for"),
           r6("odds_move_abs_for", "odds_move_abs_for"), r6("prob_shift_for", "prob_shift_for"),
           r6("travel_km_team", "travel_km_team"), r6("opponent_ppg", "opponent_ppg")]
    return f"WITH {M}, {LONG_SQL} SELECT {', '.join(sel)} FROM l"


# ------------------------------------------------------------------ parsing
def parse_ts_mixed_sql() -> str:
    """Expected times from the order's own date, not from the text."""
    return """
WITH ts AS (
  SELECT o_orderkey, o_orderkey % 7 AS k, o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE AS t FROM orders)
SELECT o_orderkey,
  CASE WHEN o_orderkey % 50 = 0 THEN 'bad ' || CAST(o_orderkey AS VARCHAR)
       WHEN k = 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S')
       WHEN k = 1 THEN strftime(t, '%b %-d %Y - %-I:%M%p')
       WHEN k = 2 THEN strftime(t, '%Y-%m-%d')
       WHEN k = 3 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ')
       WHEN k = 4 THEN strftime(t, '%Y-%m-%dT%H:%M:%S.250')
       WHEN k = 5 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+02:00')
       ELSE strftime(t, '%d/%m/%Y %H:%M') END AS raw,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL
       WHEN k = 2 THEN date_trunc('day', t)
       WHEN k = 4 THEN t + INTERVAL 250 MILLISECOND
       WHEN k = 5 THEN t - INTERVAL 2 HOUR
       WHEN k = 6 AND day(t) <= 12 THEN make_timestamp(year(t), day(t), month(t), hour(t), minute(t), 0.0)
       ELSE t END AS parsed
FROM ts"""


def parse_kickoff_sql() -> str:
    return """
WITH ts AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE AS t FROM orders),
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a'
        ELSE strftime(t, '%b %-d %Y - %-I:%M%p') END AS raw FROM ts)
SELECT o_orderkey, try_strptime(trim(raw), '%b %d %Y - %I:%M%p') AS kickoff FROM d"""


def parse_date_fallback_sql() -> str:
    return """
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS raw FROM orders),
p AS (SELECT o_orderkey,
        CAST(try_strptime(trim(raw), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d']) AS DATE) AS iso,
        CAST(try_strptime(trim(raw), ['%d/%m/%Y', '%d-%m-%Y']) AS DATE) AS dayfirst
      FROM d)
SELECT o_orderkey, strftime(CASE WHEN (SELECT coalesce(bool_or(iso IS NOT NULL), false) FROM p) THEN iso
                        ELSE dayfirst END, '%Y-%m-%d') AS match_date
FROM p"""


def coerce_numeric_sql() -> str:
    value = "CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN NULL ELSE p_size + 0.5E0 END"
    return f"SELECT p_partkey, {r6(value, 'value')} FROM part"


def _season_year(s: str) -> str:
    a = f"regexp_extract(trim({s}), '^(\\d{{4}})-(\\d{{4}})$', 1)"
    b = f"regexp_extract(trim({s}), '^(\\d{{4}})-(\\d{{4}})$', 2)"
    return (f"CASE WHEN {a} <> '' AND TRY_CAST({b} AS INTEGER) = TRY_CAST({a} AS INTEGER) + 1 "
            f"THEN TRY_CAST({a} AS INTEGER) END")


def season_year_sql() -> str:
    bad = "substr(season, 1, 5) || CAST(TRY_CAST(substr(season, 1, 4) AS INTEGER) + 2 AS VARCHAR)"
    return (f"WITH {M}, s AS (SELECT DISTINCT CASE WHEN match_id % 11 = 0 THEN {bad} ELSE season END AS season FROM m) "
            f"SELECT season, {i64(_season_year('season'), 'start_year')} FROM s")


def season_range_sql() -> str:
    return (f"WITH {M}, b AS (SELECT league_id, {_season_year('min(season)')} AS a, {_season_year('max(season)')} AS z "
            f"FROM m GROUP BY league_id) "
            f"SELECT league_id, CAST(y AS VARCHAR) || '-' || CAST(y + 1 AS VARCHAR) AS season "
            f"FROM b, LATERAL (SELECT unnest(generate_series(least(a, z), greatest(a, z))) AS y)")


def market_value_sql() -> str:
    raw = """CASE p_partkey % 7 WHEN 0 THEN '€' || CAST(p_size AS VARCHAR) || '.20m'
      WHEN 1 THEN '€' || CAST(p_size AS VARCHAR) || '50k' WHEN 2 THEN '-'
      WHEN 3 THEN '€' || CAST(p_size AS VARCHAR) || ',5m' WHEN 4 THEN '€1.' || CAST(p_size AS VARCHAR) || 'bn'
      WHEN 5 THEN '€' || CAST(p_size AS VARCHAR) || 'd' ELSE ' ' END"""
    val = """CASE WHEN s = '' OR s = '-' OR s IS NULL THEN NULL
      WHEN s LIKE '%bn' THEN TRY_CAST(substr(s, 1, length(s) - 2) AS DOUBLE) * 1e9
      WHEN s LIKE '%m' THEN TRY_CAST(substr(s, 1, length(s) - 1) AS DOUBLE) * 1e6
      WHEN s LIKE '%k' THEN TRY_CAST(substr(s, 1, length(s) - 1) AS DOUBLE) * 1e3
      ELSE TRY_CAST(s AS DOUBLE) END"""
    return f"""
WITH d AS (SELECT p_partkey, {raw} AS raw FROM part),
c AS (SELECT p_partkey, raw, replace(replace(replace(lower(trim(raw)), ' ', ''), ',', '.'), '€', '') AS s FROM d)
SELECT p_partkey, raw, {r6(val, 'value_eur')} FROM c"""


# ------------------------------------------------------------------ entity resolution
def team_key(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), '[^a-zA-Z0-9]+', '', 'g')"


def team_key_sql() -> str:
    return f"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS name
           FROM documents)
SELECT name, {team_key('name')} AS team_key FROM w WHERE name <> ''"""


def _builtin_alias_values() -> str:
    from pitchline.operators.entity import BUILTIN_TEAM_ALIAS_GROUPS
    rows = [f"({gi}, {ai}, '{g[0]}', '{a}')" for gi, g in enumerate(BUILTIN_TEAM_ALIAS_GROUPS) for ai, a in enumerate(g)]
    return "VALUES " + ", ".join(rows)


ALIAS_TABLE_SQL = """
aliases_t AS (SELECT 'NATION_' || CAST(n_nationkey AS VARCHAR) AS master_name,
         'N' || CAST(n_nationkey AS VARCHAR) || ' Club' AS football_data_name,
         CAST(n_nationkey AS BIGINT) AS row_no FROM nation WHERE n_nationkey % 7 <> 3)"""


def _alias_map_cte() -> str:
    return f"""
bi AS (SELECT * FROM ({_builtin_alias_values()}) t(g, a, canonical, variant)),
ar AS (SELECT {team_key('master_name')} AS c, {team_key('football_data_name')} AS v, row_no AS ord
       FROM aliases_t WHERE master_name IS NOT NULL AND football_data_name IS NOT NULL),
ar2 AS (SELECT * FROM ar WHERE c <> '' AND v <> '' AND c IS NOT NULL AND v IS NOT NULL),
allr AS (
  SELECT {team_key('variant')} AS variant_key, {team_key('canonical')} AS canonical_key,
         2 * 1000000000000 + g * 1000 + a AS prio FROM bi
  UNION ALL SELECT {team_key('canonical')}, {team_key('canonical')}, 1 * 1000000000000 + g FROM bi
  UNION ALL SELECT v, c, 3 * 1000000000000 + ord FROM ar2
  UNION ALL SELECT c, c, 0 * 1000000000000 + ord FROM ar2),
amap AS (SELECT variant_key, arg_max(canonical_key, prio) AS canonical_key FROM allr GROUP BY variant_key)"""


def alias_map_sql() -> str:
    return f"WITH {ALIAS_TABLE_SQL.strip()}, {_alias_map_cte().strip()} SELECT * FROM amap"


def canonical_team_sql() -> str:
    return f"""
WITH {M}, {ALIAS_TABLE_SQL.strip()}, {_alias_map_cte().strip()},
names AS (SELECT n_name AS name FROM nation UNION SELECT home_team FROM m UNION SELECT away_team FROM m)
SELECT name, coalesce(amap.canonical_key, {team_key('name')}) AS team_key
FROM names LEFT JOIN amap ON amap.variant_key = {team_key('name')}"""


ANCHOR_SQL = """(?is)<a\\s[^>]*?href\\s*=\\s*("[^"]*"|''[^'']*'')[^>]*>(.*?)</a\\s*>"""
TAG_SQL = "'<[^>]*>', ' ', 'g'"


def page_links_sql() -> str:
    text = f"regexp_replace(unnest(t), {TAG_SQL})"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '{ANCHOR_SQL}', 1) AS h,
                  regexp_extract_all(html, '{ANCHOR_SQL}', 2) AS t FROM pages),
e AS (SELECT page_id, unnest(h) AS q, {text} AS raw, unnest(range(len(h))) AS pos FROM x),
f AS (SELECT page_id, substr(q, 2, length(q) - 2) AS href, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS link_text, pos FROM e)
SELECT page_id, href, {i64('min(pos)', 'pos')}, arg_min(link_text, pos) AS link_text FROM f WHERE link_text <> '' GROUP BY page_id, href"""


def team_links_sql() -> str:
    """The teams from the customers themselves."""
    return """
SELECT CAST(2020 AS BIGINT) AS season_id, CAST(c_custkey AS VARCHAR) AS team_id, 'team-' || CAST(c_custkey AS VARCHAR) AS slug,
  'Team & ' || c_name AS tm_team_name
FROM customer WHERE c_custkey % 6 <> 0"""


def squad_rows_sql() -> str:
    """The players from the suppliers themselves."""
    value = "(s_suppkey % 90 + 1 + 0.5E0) * CASE WHEN s_suppkey % 4 = 0 THEN 1e3 ELSE 1e6 END"
    return f"""
WITH s AS (SELECT *, s_nationkey * 10000000 + s_suppkey // 40 AS page_id,
             row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 40 ORDER BY s_suppkey) - 1 AS all_pos FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(all_pos AS BIGINT) AS row_pos,
  CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 2 = 1 THEN s_name ELSE 'A & ' || s_name END AS player_name,
  {r6(value, 'player_market_value_eur')}
FROM s WHERE s_suppkey % 11 <> 0"""


MASTER_SQL = "mm AS (SELECT m.*, r.r_name AS league FROM m LEFT JOIN region r ON r.r_regionkey = m.league_id)"


def _skeleton_cte(where: str = "", label: str = "ALL") -> str:
    return f"""
sk0 AS (SELECT season, CAST(kickoff AS DATE) AS match_date, home_team, away_team FROM mm
        WHERE kickoff IS NOT NULL {where}),
sk AS (SELECT DISTINCT '{label}' AS league, season, match_date, team_name
       FROM (SELECT season, match_date, home_team AS team_name FROM sk0
             UNION ALL SELECT season, match_date, away_team FROM sk0))"""


SK_COLS = f"league, season, {d10('match_date', 'match_date')}, team_name"


def skeleton_sql() -> str:
    return f"WITH {M}, {MASTER_SQL}, {_skeleton_cte().strip()} SELECT {SK_COLS} FROM sk"


def filter_league_sql() -> str:
    cte = _skeleton_cte("AND lower(CAST(league AS VARCHAR)) = 'europe'", "EUROPE").strip()
    return f"WITH {M}, {MASTER_SQL}, {cte} SELECT {SK_COLS} FROM sk"


ENRICH_SQL = """
meta AS (
  SELECT st.season, TRY_CAST(substr(st.season, 1, 4) AS INTEGER) AS tm_season_id,
    CAST(n.n_nationkey AS VARCHAR) AS team_id, lower(n.n_name) AS slug,
    CASE WHEN n.n_nationkey % 3 = 0 THEN 'Natión ' || CAST(n.n_nationkey AS VARCHAR)
         WHEN n.n_nationkey % 3 = 1 THEN 'N' || CAST(n.n_nationkey AS VARCHAR) || ' Club'
         ELSE lower(n.n_name) END AS tm_team_name
  FROM (SELECT DISTINCT season, TRY_CAST(substr(team_name, 8, 10) AS INTEGER) AS nk FROM sk) st
  JOIN nation n ON st.nk = n.n_nationkey),
players AS (
  SELECT meta.season, meta.tm_season_id, meta.team_id, s.s_name AS player_name,
    s.s_acctbal * 1000.0E0 + meta.tm_season_id AS player_market_value_eur
  FROM supplier s JOIN meta ON CAST(s.s_nationkey AS VARCHAR) = meta.team_id),
squad AS (
  SELECT meta.*, p.squad_market_value_sum, coalesce(p.player_count_with_value, 0) AS player_count_with_value
  FROM meta LEFT JOIN (SELECT season, team_id, sum(player_market_value_eur) AS squad_market_value_sum,
                         count(player_market_value_eur) AS player_count_with_value
                       FROM players GROUP BY season, team_id) p USING (season, team_id)),
mn AS (
  SELECT DISTINCT season, team_name, coalesce(a.canonical_key, {tk_team}) AS team_key
  FROM (SELECT DISTINCT season, team_name FROM sk) s LEFT JOIN amap a ON a.variant_key = {tk_team}),
resolved AS (
  SELECT sq.*, coalesce(a.canonical_key, {tk_meta}) AS team_key, mn.team_name,
    coalesce(mn.team_name, sq.tm_team_name) AS resolved_team_name
  FROM squad sq LEFT JOIN amap a ON a.variant_key = {tk_meta}
  LEFT JOIN mn ON mn.season = sq.season AND mn.team_key = coalesce(a.canonical_key, {tk_meta})),
squad_out AS (
  SELECT season, resolved_team_name AS team_name, squad_market_value_sum, team_id FROM resolved),
merged AS (
  SELECT sk.*, so.squad_market_value_sum, so.team_id
  FROM sk LEFT JOIN squad_out so USING (season, team_name))"""


def _enrich(select: str) -> str:
    body = ENRICH_SQL.format(tk_team=team_key("s.team_name"), tk_meta=team_key("sq.tm_team_name"))
    return (f"WITH {M}, {MASTER_SQL}, {_skeleton_cte().strip()}, {ALIAS_TABLE_SQL.strip()}, "
            f"{_alias_map_cte().strip()}, {body.strip()}\n{select}")


def url_template_sql() -> str:
    return _enrich("SELECT season, team_id, 'https://squads.example/' || slug || '/kader/verein/' || team_id "
                   "|| '/saison_id/' || CAST(tm_season_id AS VARCHAR) AS url FROM meta")


def squad_value_sql() -> str:
    return _enrich(f"SELECT season, team_id, tm_team_name, {i64('player_count_with_value', 'player_count_with_value')}, "
                   f"{r6('squad_market_value_sum', 'squad_market_value_sum')} FROM squad")


def resolve_teams_sql() -> str:
    return _enrich("SELECT season, team_id, tm_team_name, team_key, team_name, resolved_team_name FROM resolved")


def unresolved_teams_sql() -> str:
    return _enrich("SELECT season, team_id, tm_team_name, team_key FROM resolved WHERE team_name IS NULL")


def skeleton_with_value_sql() -> str:
    return _enrich(f"SELECT league, season, {d10('match_date', 'match_date')}, team_name, "
                   f"{r6('squad_market_value_sum', 'squad_market_value_sum')}, team_id FROM merged")


def duplicate_keys_sql() -> str:
    return ("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem "
            "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")


def coverage_sql() -> str:
    return _enrich(f"""SELECT
  (SELECT count(*) FROM mm) AS master_rows, (SELECT count(*) FROM sk) AS skeleton_rows,
  (SELECT count(*) FROM meta) AS team_seasons_discovered, (SELECT count(*) FROM squad_out) AS unique_team_season_rows,
  (SELECT count(*) FROM players) AS player_value_rows,
  (SELECT count(*) FROM resolved WHERE team_name IS NULL) AS unresolved_team_name_mappings,
  (SELECT count(*) FROM merged WHERE squad_market_value_sum IS NULL) AS skeleton_rows_missing_squad_value,
  (SELECT {r6('coalesce(avg(CASE WHEN squad_market_value_sum IS NOT NULL THEN 1.0E0 ELSE 0.0E0 END), 0.0E0)', 'c')} FROM merged) AS coverage_ratio""")


# ------------------------------------------------------------------ training table and preparation
HT_SQL = """
ht AS (
  SELECT match_id, epoch(t)::BIGINT AS "timestamp",
    CASE WHEN match_id % 211 = 0 THEN 'TBD' ELSE strftime(t, '%b %-d %Y - %-I:%M%p') END AS date_GMT,
    CASE WHEN match_id % 301 = 0 THEN NULL ELSE season END AS season,
    'complete' AS status, 'Stadium ' || home_team AS stadium_name,
    'Referee ' || CAST(match_id % 40 AS VARCHAR) AS referee,
    home_team AS home_team_name, away_team AS away_team_name, weekofyear(kickoff) AS "Game Week",
    hth AS home_team_goal_count_half_time, hta AS away_team_goal_count_half_time,
    hth + hta AS total_goals_at_half_time,
    CASE WHEN hth > hta THEN 'H' WHEN hth = hta THEN 'D' WHEN hth < hta THEN 'A' END AS ht_result,
    match_id % 4 AS home_team_first_half_cards, (match_id // 4) % 4 AS away_team_first_half_cards,
    hth - hta AS half_time_lead,
    result AS target_match_result, home_goals AS target_home_team_goal_count,
    away_goals AS target_away_team_goal_count, home_goals + away_goals AS target_total_goal_count,
    home_ppg AS "Pre-Match PPG (Home)", away_ppg AS "Pre-Match PPG (Away)",
    home_xg AS "Home Team Pre-Match xG", away_xg AS "Away Team Pre-Match xG",
    odds_move_home, odds_move_away, abs(odds_move_home) AS odds_move_abs_home,
    prob_shift_home AS implied_prob_shift_home, travel_km AS travel_distance_km,
    home_ppg - away_ppg AS ppg_differential, home_xg * 2.0E0 - away_xg AS xg_power_index,
    1.0E0 AS capacity, home_xg * 10.0E0 AS home_xg_x10
  FROM (SELECT *, kickoff + ((match_id % 96) * 15) * INTERVAL 1 MINUTE AS t,
          CASE WHEN home_goals IS NOT NULL THEN least(home_goals, match_id % 3) END AS hth,
          CASE WHEN away_goals IS NOT NULL THEN least(away_goals, (match_id // 3) % 3) END AS hta
        FROM m) x),
hc AS (
  SELECT * FROM ht WHERE target_match_result IS NOT NULL
    AND NOT coalesce(season IN ('2025-2026'), false)),
hp AS (SELECT * REPLACE (try_strptime(trim(date_GMT), '%b %d %Y - %I:%M%p') AS date_GMT) FROM hc),
hs AS (
  SELECT *, row_number() OVER (ORDER BY date_GMT ASC NULLS LAST, match_id) - 1 AS pos,
    count(*) OVER () AS n_rows FROM hp),
hsplit AS (
  SELECT *, CASE WHEN pos < floor(CAST(n_rows AS DOUBLE) * 0.7E0) THEN 'train'
                 WHEN pos < floor(CAST(n_rows AS DOUBLE) * 0.85E0) THEN 'val' ELSE 'test' END AS split
  FROM hs)"""

HT_NUMERIC = ["home_team_goal_count_half_time", "away_team_goal_count_half_time", "total_goals_at_half_time",
              "home_team_first_half_cards", "away_team_first_half_cards", "half_time_lead",
              "Pre-Match PPG (Home)", "Pre-Match PPG (Away)", "Home Team Pre-Match xG", "Away Team Pre-Match xG",
              "odds_move_home", "odds_move_away", "odds_move_abs_home", "implied_prob_shift_home",
              "travel_distance_km", "ppg_differential", "xg_power_index", "capacity", "home_xg_x10",
              "ht_result_encoded"]
HT_ENCODED = ("hx AS (SELECT * EXCLUDE (ht_result), CASE ht_result WHEN 'H' THEN 0 WHEN 'D' THEN 1 "
              "WHEN 'A' THEN 2 END AS ht_result_encoded FROM hsplit)")


def qi(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def _ht(select: str) -> str:
    return f"WITH {M}, {HT_SQL.strip()}, {HT_ENCODED}\n{select}"


def clean_data_sql() -> str:
    return (f"WITH {M}, {HT_SQL.strip()} SELECT match_id, season, target_match_result FROM ht "
            f"WHERE target_match_result IS NOT NULL AND NOT coalesce(season IN ('1996-1997'), false)")


def filter_seasons_sql() -> str:
    return (f"WITH {M}, {HT_SQL.strip()} SELECT match_id, season FROM ht "
            f"WHERE season IN ('1995-1996', '1997-1998')")


def time_split_sql() -> str:
    return _ht(f"SELECT match_id, {i64('pos', 'pos')}, split FROM hsplit")


def walk_forward_sql() -> str:
    return _ht("""SELECT match_id, CAST(pos AS BIGINT) AS pos, CAST(n_rows // 6 AS BIGINT) AS fold_size,
  CAST(CASE WHEN n_rows // 6 > 0 AND pos // (n_rows // 6) < 5 THEN pos // (n_rows // 6) END AS BIGINT) AS train_from_fold,
  CAST(CASE WHEN n_rows // 6 > 0 AND pos // (n_rows // 6) BETWEEN 1 AND 5 THEN pos // (n_rows // 6) - 1 END AS BIGINT) AS val_fold
FROM hsplit""")


def split_counts_sql() -> str:
    return _ht("""SELECT split, 'season' AS kind, season AS value, count(*) AS n FROM hsplit GROUP BY split, season
UNION ALL SELECT split, 'class', target_match_result, count(*) FROM hsplit GROUP BY split, target_match_result""")


def class_dist_sql() -> str:
    return _ht(f"SELECT target_match_result, {r6('count(*) / (SELECT count(*) FROM hsplit)', 'share')} "
               f"FROM hsplit GROUP BY target_match_result")


def season_dist_sql() -> str:
    cols = ", ".join(r6(f"count(*) FILTER (WHERE target_match_result = '{x}') / count(*)", x) for x in ("H", "D", "A"))
    return _ht(f"SELECT season, {cols}, count(*) AS count FROM hsplit GROUP BY season")


def split_ranges_sql() -> str:
    return _ht("SELECT split, min(date_GMT) AS first_time, max(date_GMT) AS last_time, count(*) AS rows "
               "FROM hsplit GROUP BY split")


def label_encode_sql() -> str:
    return _ht("SELECT match_id, target_match_result, CAST(CASE target_match_result WHEN 'H' THEN 0 WHEN 'D' THEN 1 "
               "WHEN 'A' THEN 2 END AS BIGINT) AS label FROM hsplit")


def prematch_projection_sql() -> str:
    from pitchline.sources.training import HALFTIME_COLUMNS, IDENTIFIER_COLUMNS, TARGET_COLUMNS
    from pitchline.sources.training import TABLE_COLUMNS
    ex = set(HALFTIME_COLUMNS + IDENTIFIER_COLUMNS + TARGET_COLUMNS)
    cols = ", ".join(r6(qi(c), qi(c)) for c in TABLE_COLUMNS if c not in ex)
    return f"WITH {M}, {HT_SQL.strip()} SELECT match_id, {cols} FROM ht"


def halftime_projection_sql() -> str:
    from pitchline.sources.training import IDENTIFIER_COLUMNS, TARGET_COLUMNS
    from pitchline.sources.training import TABLE_COLUMNS
    ex = set(IDENTIFIER_COLUMNS + TARGET_COLUMNS)
    cols = ", ".join(qi(c) if c == "ht_result" else r6(qi(c), qi(c)) for c in TABLE_COLUMNS if c not in ex)
    return f"WITH {M}, {HT_SQL.strip()} SELECT match_id, {cols} FROM ht"


def feature_subset_sql() -> str:
    from pitchline.operators.prep import CORE_FEATURES
    from pitchline.sources.training import TABLE_COLUMNS
    cols = ", ".join(r6(qi(c), qi(c)) for c in CORE_FEATURES if c in TABLE_COLUMNS)
    return f"WITH {M}, {HT_SQL.strip()} SELECT match_id, {cols} FROM ht"


def feature_subset_modes_sql() -> str:
    from pitchline.operators.prep import CORE_FEATURES, FEATURES_TO_DROP
    from pitchline.sources.training import TABLE_COLUMNS
    have = [c for c in TABLE_COLUMNS if c != "ht_result"] + ["ht_result_encoded"]
    modes = {"aggressive": [c for c in have if c in CORE_FEATURES], "conservative": [c for c in have if c not in FEATURES_TO_DROP],
             "minimal": [c for c in have if c != "ht_result_encoded"], "none": have}
    rows = [f"SELECT '{m}' AS mode, '{c}' AS feature, count({qi(c) if c != 'ht_result_encoded' else 'ht_result'}) AS filled FROM ht" for m, cs in modes.items() for c in cs]
    return f"WITH {M}, {HT_SQL.strip()} " + " UNION ALL ".join(rows)


def skeleton_date_columns_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS league, * FROM t" for c in ("match_date", "match_datetime_utc", "kickoff_utc", "datetime_utc"))
    return f"""WITH {M}, t AS (SELECT season, {d10('kickoff', 'match_date')}, home_team AS team_name FROM m WHERE kickoff IS NOT NULL
  UNION SELECT season, {d10('kickoff', 'match_date')}, away_team FROM m WHERE kickoff IS NOT NULL) {rows}"""


def impute_sql(strategy: str) -> str:
    if strategy == "median":
        fill = lambda c: f"(SELECT median({qi(c)}) FROM hx WHERE split = 'train')"
    elif strategy == "mean":
        fill = lambda c: f"(SELECT avg({qi(c)}) FROM hx WHERE split = 'train')"
    else:
        fill = lambda c: "0.0E0"
    cols = ", ".join(r6(f"coalesce(CAST({qi(c)} AS DOUBLE), {fill(c)}, 0.0E0)", qi(c)) for c in HT_NUMERIC)
    return _ht(f"SELECT match_id, {cols} FROM hx")


def impute_per_split_sql() -> str:
    med = ", ".join(f"median({qi(c)}) AS f{i}" for i, c in enumerate(HT_NUMERIC))
    cols = ", ".join(r6(f"coalesce(CAST({qi(c)} AS DOUBLE), f{i}, 0.0E0)", qi(c)) for i, c in enumerate(HT_NUMERIC))
    return _ht(f"SELECT match_id, split, {cols} FROM hx JOIN (SELECT split, {med} FROM hx GROUP BY split) USING (split)")


def _standard(c: str, table: str) -> str:
    return (f"({qi(c)} - (SELECT avg({qi(c)}) FROM {table} WHERE split = 'train')) / "
            f"coalesce(nullif((SELECT stddev_pop({qi(c)}) FROM {table} WHERE split = 'train'), 0), 1)")


def standardize_sql() -> str:
    return _ht(f"SELECT match_id, {', '.join(r6(_standard(c, 'hx'), qi(c)) for c in HT_NUMERIC)} FROM hx")


def class_weights_sql() -> str:
    return _ht(f"""SELECT target_match_result, count(*) AS n_c,
  {r6("(SELECT count(*) FROM hsplit WHERE split = 'train') / ((SELECT count(DISTINCT target_match_result) FROM hsplit WHERE split = 'train') * count(*))", 'weight')}
FROM hsplit WHERE split = 'train' GROUP BY target_match_result""")


# ------------------------------------------------------------------ screening
def _xt() -> str:
    cols = ", ".join(f"coalesce(CAST({qi(c)} AS DOUBLE), (SELECT median({qi(c)}) FROM hx WHERE split = 'train'), 0.0E0) "
                     f"AS {qi(c)}" for c in HT_NUMERIC)
    return (f"xt AS (SELECT match_id, CASE target_match_result WHEN 'H' THEN 0 WHEN 'D' THEN 1 WHEN 'A' THEN 2 END "
            f"AS lbl, {cols} FROM hx WHERE split = 'train')")


def _pairs_cte() -> str:
    idx = [(i, j) for i in range(len(HT_NUMERIC)) for j in range(i + 1, len(HT_NUMERIC))]
    aggs = ", ".join(f"covar_samp({qi(HT_NUMERIC[i])}, {qi(HT_NUMERIC[j])}) / "
                     f"nullif(stddev_samp({qi(HT_NUMERIC[i])}) * stddev_samp({qi(HT_NUMERIC[j])}), 0) AS r{k}"
                     for k, (i, j) in enumerate(idx))
    un = " UNION ALL ".join(f"SELECT '{HT_NUMERIC[i]}' AS feature_1, '{HT_NUMERIC[j]}' AS feature_2, r{k} AS correlation FROM ra"
                            for k, (i, j) in enumerate(idx))
    imp = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(coalesce(abs(covar_samp({qi(c)}, lbl) / nullif(stddev_samp({qi(c)}) * "
        f"stddev_samp(lbl), 0)), 0.0E0), 9) AS importance FROM xt" for c in HT_NUMERIC)
    return (f"{_xt()}, ra AS (SELECT {aggs} FROM xt), pairs AS ({un}), imp AS ({imp}),\n"
            f"hcp AS (SELECT *, abs(correlation) AS abs_correlation FROM pairs WHERE correlation IS NOT NULL "
            f"AND NOT isnan(correlation) AND abs(correlation) > 0.8)")


def _scr(select: str) -> str:
    return f"WITH RECURSIVE {M}, {HT_SQL.strip()}, {HT_ENCODED}, {_pairs_cte()}\n{select}"


def corr_matrix_sql() -> str:
    return _scr(f"SELECT feature_1, feature_2, {r6('correlation', 'correlation')} FROM pairs")


def corr_pairs_sql() -> str:
    return _scr(f"SELECT feature_1, feature_2, {r6('correlation', 'correlation')}, "
                f"{r6('abs_correlation', 'abs_correlation')} FROM hcp")


def low_variance_sql() -> str:
    un = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({qi(c)}) AS variance FROM xt" for c in HT_NUMERIC)
    return _scr(f"SELECT feature, {r6('variance', 'variance')} FROM ({un}) v WHERE variance < 0.01")


def redundant_features_sql() -> str:
    return _scr("SELECT DISTINCT feature_2 AS feature FROM pairs WHERE correlation IS NOT NULL "
                "AND NOT isnan(correlation) AND abs(correlation) > 0.9")


CORR_GROUPS = """,
edges AS (SELECT feature_1 AS a, feature_2 AS b FROM hcp UNION SELECT feature_2, feature_1 FROM hcp),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
lab AS (SELECT a AS feature, least(min(b), a) AS grp FROM reach GROUP BY a),
grp AS (SELECT feature, grp AS "group", count(*) OVER (PARTITION BY grp) AS group_size FROM lab)"""


def corr_groups_sql() -> str:
    return (
        f"WITH RECURSIVE {M}, {HT_SQL.strip()}, {HT_ENCODED}, {_pairs_cte()}{CORR_GROUPS}\n"
        f"SELECT feature, \"group\", group_size FROM grp")


KEEP_DROP = """,
kd AS (
  SELECT g."group", g.group_size, g.feature, coalesce(i.importance, 0.0E0) AS importance,
    CASE WHEN row_number() OVER (PARTITION BY g."group" ORDER BY coalesce(i.importance, 0.0E0) DESC, g.feature) = 1
         THEN 'keep' ELSE 'drop' END AS action
  FROM grp g LEFT JOIN imp i USING (feature))"""


def _kd(select: str) -> str:
    return f"WITH RECURSIVE {M}, {HT_SQL.strip()}, {HT_ENCODED}, {_pairs_cte()}{CORR_GROUPS}{KEEP_DROP}\n{select}"


def corr_keep_drop_sql() -> str:
    return _kd(f"SELECT \"group\", group_size, feature, {r6('importance', 'importance')}, action FROM kd")


def kept_features_sql() -> str:
    return _kd("SELECT feature FROM imp WHERE feature NOT IN (SELECT feature FROM kd WHERE action = 'drop')")


def top_features_sql() -> str:
    return _scr(f"SELECT feature, {r6('importance', 'importance')} FROM imp ORDER BY importance DESC, feature LIMIT 10")


def corr_submatrix_sql() -> str:
    return _scr(f"""SELECT a.f AS feature_1, b.f AS feature_2,
  {r6('CASE WHEN a.f = b.f THEN 1.0E0 ELSE p.correlation END', 'correlation')}
FROM chosen a CROSS JOIN chosen b
LEFT JOIN pairs2 p ON p.feature_1 = a.f AND p.feature_2 = b.f""").replace(
        "\nSELECT a.f", """,
top AS MATERIALIZED (SELECT feature_1, feature_2 FROM hcp
        ORDER BY round(abs_correlation, 9) DESC, feature_1, feature_2 LIMIT 40),
chosen AS MATERIALIZED (SELECT f FROM (SELECT feature_1 AS f FROM top UNION SELECT feature_2 FROM top) ORDER BY f LIMIT 30),
pairs2 AS MATERIALIZED (SELECT feature_1, feature_2, correlation FROM pairs UNION ALL SELECT feature_2, feature_1, correlation FROM pairs)
SELECT a.f""", 1).replace("pairs AS (", "pairs AS MATERIALIZED (", 1).replace("xt AS (", "xt AS MATERIALIZED (", 1)


def screening_report_sql() -> str:
    un = " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({qi(c)}) AS variance FROM xt" for c in HT_NUMERIC)
    return _scr(f"""SELECT feature, 'low_variance' AS reason FROM ({un}) v WHERE variance < 0.01
UNION ALL SELECT DISTINCT feature_2, 'redundant' FROM pairs WHERE correlation IS NOT NULL
  AND NOT isnan(correlation) AND abs(correlation) > 0.9
UNION ALL SELECT '{len(HT_NUMERIC)}', 'total_features'
UNION ALL SELECT feature, 'selected_by_importance' FROM (SELECT feature FROM imp ORDER BY importance DESC, feature LIMIT 5) t""")


def corr_with_gaps_sql() -> str:
    cols = ["home_goals", "away_goals", "odds_move_home", "odds_move_away", "travel_km"]
    un = " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r6(f'corr({a}, {b})', 'correlation')} FROM m"
                            for i, a in enumerate(cols) for b in cols[i + 1:])
    return f"WITH {M} {un}"


def component_chain_sql() -> str:
    return """
WITH e AS (SELECT c_custkey AS a FROM customer WHERE c_custkey % 500 <> 499),
n AS (SELECT a AS node FROM e UNION SELECT a + 1 FROM e)
SELECT CAST(node AS BIGINT) AS node, CAST(min(node) OVER (PARTITION BY node // 500) AS BIGINT) AS label FROM n"""


def with_odd_matches(sql: str, no_home: str = "NULL", no_away: str = "NULL",
                     league: str = "CASE WHEN match_id % 10 = 0 THEN NULL ELSE league_id END") -> str:
    """The same query on the match table with missing leagues and teams."""
    odd = f"""m AS (SELECT * REPLACE ({league} AS league_id,
  CASE WHEN match_id % 53 = 0 THEN {no_home} ELSE home_team END AS home_team,
  CASE WHEN match_id % 53 = 0 THEN {no_away} ELSE away_team END AS away_team) FROM ({MATCHES_SQL}) m0)"""
    return sql.replace(M, odd, 1)


def venue_null_teams_sql() -> str:
    """A row without a team has no history; its match stays, with NULLs."""
    sql = with_odd_matches(venue_history_sql()).replace("FROM l)", "FROM l WHERE team IS NOT NULL)")
    return (f"SELECT h.* REPLACE (o.match_id AS match_id) FROM (SELECT o_orderkey AS match_id FROM orders JOIN customer ON o_custkey = c_custkey) o "
            f"LEFT JOIN ({sql}) h ON h.match_id = o.match_id")


# ------------------------------------------------------------------ metrics
PRED_SQL = """
pm AS (SELECT *, CASE WHEN season < '1999' THEN 'train' WHEN season < '2000' THEN 'val' ELSE 'test' END AS split,
         CASE WHEN result = 'H' THEN 'D' WHEN result = 'D' THEN 'A' ELSE 'H' END AS rot
       FROM m WHERE result IS NOT NULL),
p0 AS (
  SELECT 'home_bias' AS model, 0 AS model_ord, split, match_id, result AS y_true,
    CASE WHEN match_id % 7 = 0 THEN 'D' ELSE 'H' END AS y_pred FROM pm
  UNION ALL
  SELECT 'noisy_copy', 1, split, match_id, result, CASE WHEN match_id % 4 = 0 THEN rot ELSE result END FROM pm
  UNION ALL
  SELECT 'ppg_rule', 2, split, match_id, result,
    CASE WHEN home_ppg > away_ppg + 0.5E0 THEN 'H' WHEN away_ppg > home_ppg + 0.5E0 THEN 'A' ELSE 'D' END FROM pm),
p1 AS (
  SELECT *, (1 + match_id % 3) + CASE WHEN y_pred = 'H' THEN 3 ELSE 0 END AS sh,
    (1 + match_id % 5) + CASE WHEN y_pred = 'D' THEN 3 ELSE 0 END AS sd,
    (1 + match_id % 7) + CASE WHEN y_pred = 'A' THEN 3 ELSE 0 END AS sa FROM p0),
preds AS (
  SELECT model, model_ord, split, match_id, y_true, y_pred, CAST(sh AS DOUBLE) / (sh + sd + sa) AS p_H,
    CAST(sd AS DOUBLE) / (sh + sd + sa) AS p_D, CAST(sa AS DOUBLE) / (sh + sd + sa) AS p_A FROM p1),
lab AS (SELECT DISTINCT model, split, y_true AS label FROM preds UNION SELECT DISTINCT model, split, y_pred FROM preds),
st AS (
  SELECT l.model, l.split, l.label,
    count(*) FILTER (WHERE p.y_true = l.label AND p.y_pred = l.label) AS tp,
    count(*) FILTER (WHERE p.y_true = l.label) AS support,
    count(*) FILTER (WHERE p.y_pred = l.label) AS predicted
  FROM lab l JOIN preds p ON p.model = l.model AND p.split = l.split GROUP BY l.model, l.split, l.label),
prf AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0E0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0.0E0 END AS recall,
    CASE WHEN 2 * tp + (predicted - tp) + (support - tp) > 0
         THEN 2 * tp / (2 * tp + (predicted - tp) + (support - tp)) ELSE 0.0E0 END AS f1
  FROM st),
ll AS (
  SELECT model, split, avg(-ln(
    (CASE y_true WHEN 'H' THEN least(greatest(p_H, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
                 WHEN 'D' THEN least(greatest(p_D, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
                 WHEN 'A' THEN least(greatest(p_A, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END) /
    (least(greatest(p_H, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
     + least(greatest(p_D, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
     + least(greatest(p_A, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) AS log_loss
  FROM preds GROUP BY model, split),
met AS (
  SELECT prf.model, prf.split, sum(tp) / sum(support) AS accuracy, ll.log_loss, avg(f1) AS f1_macro,
    sum(f1 * support) / sum(support) AS f1_weighted, avg(precision) AS precision_macro, avg(recall) AS recall_macro
  FROM prf JOIN ll ON ll.model = prf.model AND ll.split = prf.split GROUP BY prf.model, prf.split, ll.log_loss)"""

METRIC_NAMES = ["accuracy", "log_loss", "f1_macro", "f1_weighted", "precision_macro", "recall_macro"]


def _met(select: str) -> str:
    return f"WITH {M}, {PRED_SQL.strip()}\n{select}"


def confusion_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE y_pred = '{x}') AS {x}" for x in ("H", "D", "A"))
    return _met(f"SELECT model, split, y_true AS actual, {cols} FROM preds GROUP BY model, split, y_true")


def class_metrics_sql() -> str:
    return _met(f"SELECT model, split, {', '.join(r6(c, c) for c in METRIC_NAMES)} FROM met")


def per_class_metrics_sql() -> str:
    return _met(f"""SELECT g.model, g.split, g.label,
  {r6('coalesce(prf.precision, 0.0E0)', 'precision')}, {r6('coalesce(prf.recall, 0.0E0)', 'recall')},
  {r6('coalesce(prf.f1, 0.0E0)', 'f1')}, coalesce(prf.support, 0) AS support
FROM (SELECT DISTINCT model, split, unnest(['H', 'D', 'A']) AS label FROM preds) g
LEFT JOIN prf ON prf.model = g.model AND prf.split = g.split AND prf.label = g.label""")


def log_loss_sql() -> str:
    return _met(f"SELECT model, split, {r6('log_loss', 'log_loss')} FROM ll")


def _met_long() -> str:
    return " UNION ALL ".join(f"SELECT model, split, '{c}' AS metric, {c} AS value FROM met" for c in METRIC_NAMES)


def best_model_sql() -> str:
    return _met(f"""SELECT metric, model, {r6('value', 'value')} FROM (
  SELECT l.metric, l.model, l.value, row_number() OVER (PARTITION BY l.metric ORDER BY l.value DESC, o.model_ord) AS rk
  FROM ({_met_long()}) l JOIN (SELECT DISTINCT model, model_ord FROM preds) o USING (model)
  WHERE l.split = 'test' AND l.metric IN ('accuracy', 'f1_macro')) WHERE rk = 1""")


def overfit_status_sql() -> str:
    gap = "(coalesce(max(accuracy) FILTER (WHERE split = 'train'), 0) - coalesce(max(accuracy) FILTER (WHERE split = 'test'), 0))"
    return _met(f"""SELECT model, {r6(gap, 'gap')},
  CASE WHEN {gap} > 0.15 THEN 'Possible overfitting' WHEN {gap} < 0 THEN 'Good generalization'
       ELSE 'Acceptable' END AS status FROM met GROUP BY model""")


def model_comparison_sql() -> str:
    return _met(f"""SELECT model, metric, {r6('value', 'value')} FROM ({_met_long()}) WHERE split = 'test'
UNION ALL SELECT g.model, 'f1_' || g.label, {r6('coalesce(prf.f1, 0.0E0)', 'v')}
FROM (SELECT DISTINCT model, split, unnest(['H', 'D', 'A']) AS label FROM preds WHERE split = 'test') g
LEFT JOIN prf ON prf.model = g.model AND prf.split = g.split AND prf.label = g.label""")


def metrics_pivot_sql() -> str:
    return _met(f"SELECT model, {', '.join(r6(c, c) for c in METRIC_NAMES)} FROM met WHERE split = 'test'")


# ------------------------------------------------------------------ Gaussian naive Bayes
def gaussian_nb_sql() -> str:
    import math
    cols = ", ".join(f"coalesce(CAST({qi(c)} AS DOUBLE), (SELECT median({qi(c)}) FROM hx WHERE split = 'train'), 0.0E0) "
                     f"AS {qi(c)}" for c in HT_NUMERIC)
    std = ", ".join(f"{_standard(c, 'xu')} AS {qi(c)}" for c in HT_NUMERIC)
    stats = ", ".join([f"avg({qi(c)}) AS mu{i}" for i, c in enumerate(HT_NUMERIC)]
                      + [f"var_pop({qi(c)}) AS var{i}" for i, c in enumerate(HT_NUMERIC)])
    eps = "greatest(" + ", ".join(f"var_pop({qi(c)})" for c in HT_NUMERIC) + ") * 1e-6"
    ll = " + ".join(f"(- {0.5 * math.log(2 * math.pi)!r} - 0.5 * ln(s.var{i} + e.eps) - "
                    f"(x.{qi(c)} - s.mu{i}) * (x.{qi(c)} - s.mu{i}) / (2 * (s.var{i} + e.eps)))"
                    for i, c in enumerate(HT_NUMERIC))
    return f"""WITH {M}, {HT_SQL.strip()}, {HT_ENCODED},
xu AS (SELECT match_id, split, target_match_result, {cols} FROM hx),
xi AS (SELECT match_id, split, target_match_result, {std} FROM xu),
s AS (SELECT target_match_result AS c, count(*) / (SELECT count(*) FROM xi WHERE split = 'train') AS prior, {stats}
      FROM xi WHERE split = 'train' GROUP BY target_match_result),
e AS (SELECT {eps} AS eps FROM xi WHERE split = 'train'),
j AS (SELECT x.match_id, x.split, s.c, ln(s.prior) + {ll} AS ll FROM xi x, s, e),
w AS (SELECT match_id, split, max(ll) FILTER (WHERE c = 'H') AS lh, max(ll) FILTER (WHERE c = 'D') AS ld,
        max(ll) FILTER (WHERE c = 'A') AS la FROM j GROUP BY match_id, split)
SELECT match_id, split,
  CASE WHEN la >= ld AND la >= lh THEN 'A' WHEN ld >= lh THEN 'D' ELSE 'H' END AS y_pred,
  {r6('exp(lh - greatest(la, ld, lh)) / (exp(la - greatest(la, ld, lh)) + exp(ld - greatest(la, ld, lh)) + exp(lh - greatest(la, ld, lh)))', 'p_H')},
  {r6('exp(ld - greatest(la, ld, lh)) / (exp(la - greatest(la, ld, lh)) + exp(ld - greatest(la, ld, lh)) + exp(lh - greatest(la, ld, lh)))', 'p_D')},
  {r6('exp(la - greatest(la, ld, lh)) / (exp(la - greatest(la, ld, lh)) + exp(ld - greatest(la, ld, lh)) + exp(lh - greatest(la, ld, lh)))', 'p_A')}
FROM w"""


# ------------------------------------------------------------------ quality
def first_match_sql() -> str:
    return (f"WITH {M}, {LONG_SQL} SELECT team, match_id FROM (SELECT team, match_id, row_number() OVER "
            f"(PARTITION BY team ORDER BY kickoff ASC NULLS LAST, match_id) AS rn FROM l) WHERE rn = 1")


def match_order_sql() -> str:
    return (f"WITH {M} SELECT match_id, CAST(row_number() OVER (ORDER BY kickoff ASC NULLS LAST, match_id) - 1 "
            f"AS BIGINT) AS pos FROM m")


def last_n_matches_sql() -> str:
    return (f"WITH {M}, {LONG_SQL} SELECT team, match_id FROM (SELECT team, match_id, row_number() OVER "
            f"(PARTITION BY team ORDER BY kickoff DESC NULLS FIRST, match_id DESC) AS rn FROM l) WHERE rn <= 5")


def range_checks_sql() -> str:
    rules = []
    for side in ("home", "away"):
        for r in ("win_rate", "draw_rate", "loss_rate"):
            rules.append((f"{side}_{r}_in_0_1", f"{side}_{r} IS NOT NULL AND ({side}_{r} < 0 OR {side}_{r} > 1)"))
        rules.append((f"{side}_wins_last5_in_0_5",
                      f"{side}_wins_last5 IS NOT NULL AND ({side}_wins_last5 < 0 OR {side}_wins_last5 > 5)"))
    un = " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM vh" for n, c in rules)
    return venue_history_sql(", vh AS (SELECT", ")") + "\n" + un


def feature_mismatches_sql() -> str:
    return f"""WITH {M}, {LONG_SQL}, {_venue_ctes().strip()}
SELECT match_id, CAST(is_home AS BIGINT) AS is_home, 'goals_for' AS feature, {r6('goals_for + 1', 'actual')}, {r6('goals_for', 'expected')}
FROM v WHERE match_id % 101 = 0
UNION ALL SELECT match_id, CAST(is_home AS BIGINT), 'win_rate', NULL, {r6('w / matches_before', 'expected')}
FROM v WHERE match_id % 103 = 0 AND matches_before > 0"""


def momentum_mismatches_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT s4.match_id, CAST(s4.is_home AS BIGINT) AS is_home, '{c}' AS feature, {r6(f'{t}.{c} + 1', 'actual')}, {r6(f'{t}.{c}', 'expected')} "
        f"FROM s4 JOIN s5 USING (match_id, is_home) WHERE s4.match_id % {n} = 0 AND {t}.{c} IS NOT NULL"
        for n, t, c in ((101, "s4", "form_pts_5"), (103, "s5", "odds_move_for_ewm_5"), (107, "s4", "rest_days")))
    return f"WITH RECURSIVE {M}, {LONG_SQL}, {ELO_SQL}, {long_features_body()}\n{parts}"


def diff_checks_sql() -> str:
    body = match_diffs_sql()
    cut = body.rindex("\nSELECT ")
    parts = " UNION ALL ".join(f"SELECT '{d}' AS diff_column, CAST(count(*) AS BIGINT) AS violations FROM dd WHERE match_id % {50 + i} = 0 AND {d} IS NOT NULL"
                               for i, (d, _) in enumerate(DIFF_PAIRS))
    return f"{body[:cut]}, dd AS MATERIALIZED ({body[cut + 1:]})\n{parts}"


def model_roundtrip_sql() -> str:
    return _ht("SELECT match_id, split, CAST(1 AS BIGINT) AS same, CAST(1 AS BIGINT) AS sums_to_one FROM hsplit")


VENUE_CTES = """
v AS (
  SELECT match_id, is_home,
    count(*) OVER {allp} AS matches_before,
    coalesce(sum(win) OVER {last5}, 0) AS wins_last5,
    sum(win) OVER {allp} AS w, sum(draw) OVER {allp} AS d, sum(loss) OVER {allp} AS lo,
    coalesce(sum(gf) OVER {allp}, 0) AS goals_for,
    coalesce(sum(ga) OVER {allp}, 0) AS goals_against,
    coalesce(sum(gd) OVER {allp}, 0) AS goal_diff
  FROM l),
vh AS (
  SELECT match_id,
    max(CASE WHEN is_home = 1 THEN CAST(w AS DOUBLE) / NULLIF(matches_before, 0) END) AS home_win_rate,
    max(CASE WHEN is_home = 1 THEN goals_for END) AS home_goals_for,
    max(CASE WHEN is_home = 1 THEN goals_against END) AS home_goals_against,
    max(CASE WHEN is_home = 1 THEN goal_diff END) AS home_goal_diff,
    max(CASE WHEN is_home = 1 THEN wins_last5 END) AS home_wins_last5,
    max(CASE WHEN is_home = 0 THEN CAST(w AS DOUBLE) / NULLIF(matches_before, 0) END) AS away_win_rate,
    max(CASE WHEN is_home = 0 THEN goals_for END) AS away_goals_for,
    max(CASE WHEN is_home = 0 THEN goals_against END) AS away_goals_against,
    max(CASE WHEN is_home = 0 THEN goal_diff END) AS away_goal_diff,
    max(CASE WHEN is_home = 0 THEN wins_last5 END) AS away_wins_last5
  FROM v GROUP BY match_id)"""


def first_match_checks_sql() -> str:
    parts = []
    for side in ("home", "away"):
        fm = (f"(SELECT vh.* FROM vh JOIN (SELECT match_id, row_number() OVER (PARTITION BY {side}_team "
              f"ORDER BY kickoff ASC NULLS LAST, match_id) AS rn FROM m) x USING (match_id) WHERE x.rn = 1)")
        rules = [(f"{side}_first_rate_not_null", f"{side}_win_rate IS NOT NULL"),
                 (f"{side}_first_gf_not_zero", f"{side}_goals_for <> 0"),
                 (f"{side}_first_ga_not_zero", f"{side}_goals_against <> 0"),
                 (f"{side}_first_gd_not_zero", f"{side}_goal_diff <> 0"),
                 (f"{side}_first_window_not_zero", f"{side}_wins_last5 <> 0")]
        for name, cond in rules:
            parts.append(f"SELECT '{name}' AS rule, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS violations FROM {fm}")
    parts.append("SELECT 'first_match_form_pts_3_not_null', CAST(count(*) FILTER (WHERE form_pts_3 IS NOT NULL) AS BIGINT) "
                 "FROM (SELECT form_pts_3, row_number() OVER (PARTITION BY team ORDER BY kickoff ASC NULLS LAST, match_id) "
                 "AS rn FROM s1) WHERE rn = 1")
    return (f"WITH RECURSIVE {M}, {LONG_SQL}, {_venue_ctes().strip()}, {ELO_SQL}, {long_features_body()}\n"
            + "\nUNION ALL ".join(parts))


def drop_columns_sql() -> str:
    return (f"WITH {M}, {HT_SQL.strip()} SELECT match_id, season, status, home_team_name, away_team_name, "
            f"target_match_result FROM ht")


def epoch_check_sql() -> str:
    return f"WITH {M}, {HT_SQL.strip()} SELECT match_id, \"timestamp\" FROM ht"
