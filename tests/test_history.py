"""Venue history (W1-W7) and momentum (W8-W19) against brute-force
recomputation from all earlier rows (the reference's own checker shape),
on hand-made edge rows and on the sf0.001 fixture."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from fixtures import edge_matches
from pitchline.operators.history import venue_history
from pitchline.operators.long_table import long_table
from pitchline.operators.momentum import long_features
from pitchline.sources.tables import matches

TOL = 1e-9


def close(a, b):
    na = a is None or (isinstance(a, float) and math.isnan(a))
    nb = b is None or (isinstance(b, float) and math.isnan(b))
    if na or nb:
        return na and nb
    return math.isclose(float(a), float(b), rel_tol=TOL, abs_tol=TOL)


def brute_venue(m: pd.DataFrame, window=5):
    m = m.sort_values(["kickoff", "match_id"]).reset_index(drop=True)
    out = {}
    for i, r in m.iterrows():
        prior = m.iloc[:i]
        for side, flag_win, flag_draw, flag_loss in (("home", "H", "D", "A"), ("away", "A", "D", "H")):
            team = r[f"{side}_team"]
            if team is None:
                continue
            h = prior[prior[f"{side}_team"] == team]
            n = len(h)
            gf = h[f"{side}_goals"].astype(float)
            ga = h[("away" if side == "home" else "home") + "_goals"].astype(float)
            win = (h["result"] == flag_win).astype(int)
            e = {
                "matches_before": n,
                "wins_last5": float(win.tail(window).sum()),
                "win_rate": np.nan if n == 0 else win.sum() / n,
                "draw_rate": np.nan if n == 0 else (h["result"] == flag_draw).sum() / n,
                "loss_rate": np.nan if n == 0 else (h["result"] == flag_loss).sum() / n,
                "goals_for": float(gf.sum()), "goals_against": float(ga.sum()),
                "goal_diff": float((gf - ga).sum()),
                "goals_for_pm": np.nan if n == 0 else gf.sum() / n,
                "goals_against_pm": np.nan if n == 0 else ga.sum() / n,
                "goal_diff_pm": np.nan if n == 0 else (gf - ga).sum() / n,
                "win_margin_avg": (gf - ga)[win == 1].mean() if (win == 1).any() else np.nan,
                "loss_margin_avg": (ga - gf)[(h["result"] == flag_loss)].mean()
                if (h["result"] == flag_loss).any() else np.nan,
            }
            for k, v in e.items():
                out[(r["match_id"], f"{side}_{k}")] = v
    return out


def check_venue(spark, m_df):
    got = venue_history(m_df).toPandas().set_index("match_id")
    exp = brute_venue(m_df.toPandas())
    bad = [(k, got.loc[k[0], k[1]], v) for k, v in exp.items() if not close(got.loc[k[0], k[1]], v)]
    assert not bad, bad[:10]


def test_venue_history_edge_rows(spark):
    check_venue(spark, edge_matches(spark))


def test_venue_history_sf_small(spark, sf_small):
    check_venue(spark, matches(spark, sf_small))


def wavg_suffix(vals, k):
    v = [x for x in vals[-k:] if x is not None and not (isinstance(x, float) and math.isnan(x))]
    if not v:
        return np.nan
    w = np.arange(k - len(v) + 1, k + 1, dtype=float)
    return float(np.dot(v, w) / w.sum())


def ewm_code(vals, span=5):
    s = pd.Series([np.nan] + list(vals), dtype=float)   # shifted: value of row = state after earlier rows
    return s.ewm(span=span, adjust=False).mean().iloc[-1] if len(vals) else np.nan


def test_long_features_brute_force(spark):
    m = edge_matches(spark)
    lt = long_table(m)
    got = long_features(lt).toPandas()
    lp = lt.toPandas()
    lp = lp[lp["team"].notna()].sort_values(["kickoff", "match_id"])
    bad = []
    for _, r in got.iterrows():
        if r["team"] is None:
            continue
        prior = lp[(lp["team"] == r["team"]) & ((lp["kickoff"] < r["kickoff"]) |
                   ((lp["kickoff"] == r["kickoff"]) & (lp["match_id"] < r["match_id"])))]
        pts = prior["points"].tolist()
        exp = {
            "form_pts_3": wavg_suffix(pts, 3), "form_pts_5": wavg_suffix(pts, 5), "form_pts_8": wavg_suffix(pts, 8),
            "goal_diff_5": wavg_suffix(prior["goal_diff"].tolist(), 5),
            "odds_move_for_mom_3": wavg_suffix(prior["odds_move_for"].tolist(), 3),
            "odds_move_for_ewm_5": ewm_code(prior["odds_move_for"].tolist()) if len(prior) else np.nan,
            "travel_km_ewm_5": ewm_code(prior["travel_km_team"].tolist()) if len(prior) else np.nan,
            "rest_days": np.nan if prior.empty else
            (r["kickoff"] - prior["kickoff"].iloc[-1]).total_seconds() / 86400.0,
            "venue_form_pts_5": wavg_suffix(prior[prior["is_home"] == r["is_home"]]["points"].tolist(), 5),
        }
        gd = [x for x in prior["goal_diff"].tolist()[-5:] if not (x is None or math.isnan(x))]
        exp["mom_volatility_5"] = float(np.std(gd)) if len(gd) >= 2 else np.nan
        for k, v in exp.items():
            if not close(r[k], v):
                bad.append((r["match_id"], r["team"], k, r[k], v))
    assert not bad, bad[:10]


def test_leakage(spark):
    """Changing the outcome of match t leaves every feature of matches up to
    and including t unchanged."""
    from pyspark.sql import functions as F
    from pitchline.operators.momentum import match_features
    m = edge_matches(spark)
    t = 5
    m2 = m.withColumn("home_goals", F.when(F.col("match_id") == t, F.lit(0)).otherwise(F.col("home_goals"))) \
          .withColumn("away_goals", F.when(F.col("match_id") == t, F.lit(7)).otherwise(F.col("away_goals"))) \
          .withColumn("result", F.when(F.col("match_id") == t, F.lit("A")).otherwise(F.col("result")))
    t_kick = m.where(F.col("match_id") == t).collect()[0].kickoff
    upto = [r.match_id for r in m.where(F.col("kickoff") <= F.lit(t_kick)).collect()]
    a = match_features(m).where(F.col("match_id").isin(upto)).toPandas().set_index("match_id").sort_index()
    b = match_features(m2).where(F.col("match_id").isin(upto)).toPandas().set_index("match_id").sort_index()
    pd.testing.assert_frame_equal(a, b)


def test_null_team_gets_null_side(spark):
    vh = venue_history(edge_matches(spark)).where("match_id = 11").collect()[0]
    assert vh["home_matches_before"] is None and vh["away_matches_before"] is not None


def test_ewm_tail_exact(spark):
    """A null run longer than any batch or window keeps the last state."""
    from pyspark.sql import functions as F
    from pitchline.operators.ewm import with_prior_ewm
    n = 3000
    df = spark.range(n).select(F.lit("T").alias("team"),
                               (F.timestamp_seconds(F.col("id") * 86400)).cast("timestamp_ntz").alias("kickoff"),
                               F.col("id").alias("match_id"),
                               F.when((F.col("id") > 5) & (F.col("id") < 2500), None).otherwise(F.col("id") * 1.0)
                               .alias("x")).repartition(1)
    got = with_prior_ewm(df, [("x", "e")]).orderBy("match_id").toPandas()["e"].to_numpy()
    exp = pd.Series([np.nan] + [np.nan if 5 < i < 2500 else float(i) for i in range(n)][:-1]) \
        .ewm(span=5, adjust=False).mean().to_numpy()
    assert np.allclose(got, exp, equal_nan=True, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("seg_rows", [3, 4, 7])
def test_segmented_paths_equal_plain(spark, seg_rows):
    """Tiny segments (halo 8 > segment is rejected, so the team path uses
    segments >= 9 below; venue path with halo 5 uses these)."""
    from pitchline.operators.history import venue_history
    m = edge_matches(spark)
    if seg_rows <= 5:
        with pytest.raises(ValueError):
            venue_history(m, seg_rows=seg_rows).collect()
        return
    a = venue_history(m, seg_rows=None).toPandas().set_index("match_id").sort_index()
    b = venue_history(m, seg_rows=seg_rows).toPandas().set_index("match_id").sort_index()
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, atol=1e-12)


def test_segmented_momentum_equal_plain(spark, sf_small):
    from pitchline.operators.elo import with_elo
    m = matches(spark, sf_small)
    lt = long_table(with_elo(m))
    cols = ["match_id", "is_home", "form_pts_8", "odds_move_for_ewm_5", "match_density_ewm_5",
            "travel_fatigue_mom_5", "venue_form_pts_5", "rest_days"]
    a = long_features(lt, seg_rows=None).select(*cols).toPandas().sort_values(["match_id", "is_home"]).reset_index(drop=True)
    b = long_features(lt, seg_rows=13).select(*cols).toPandas().sort_values(["match_id", "is_home"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-10)


def test_segments_are_chosen_by_the_largest_team(spark, monkeypatch):
    from pitchline.operators import history, momentum
    from pitchline.operators.segments import rows_per_segment
    m = edge_matches(spark)
    most = max(r["count"] for r in long_table(m).groupBy("team").count().collect())
    assert rows_per_segment(m) is None and rows_per_segment(m, most) is None and rows_per_segment(m, most - 1) == most - 1
    assert rows_per_segment(m.where("false")) is None
    plain = [history.venue_history(m).toPandas(), momentum.match_features(m).toPandas()]
    for mod in (history, momentum):
        monkeypatch.setattr(mod, "rows_per_segment", lambda m: 9)
    for a, b in zip(plain, [history.venue_history(m).toPandas(), momentum.match_features(m).toPandas()]):
        a, b = (d.sort_values("match_id").reset_index(drop=True) for d in (a, b))
        pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, atol=1e-10)


def test_volatility_needs_no_frame_of_its_own(spark):
    """The standard deviation comes from the lags; null and lone values as in the frame."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from pitchline.functions.columns import prior_std
    from pitchline.operators.long_table import long_table, order_by
    from pitchline.operators.momentum import long_features
    lt = long_table(edge_matches(spark))
    w = Window.partitionBy("team").orderBy(*order_by())
    wanted = {(r[0], r[1]): r[2] for r in lt.select("match_id", "is_home", prior_std("goal_diff", 5, w)).collect()}
    got = {(r[0], r[1]): r[2] for r in long_features(lt).select("match_id", "is_home", "mom_volatility_5").collect()}
    assert got.keys() == wanted.keys()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in wanted.items())
    plan = long_features(lt)._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_pop" not in plan


def test_ewm_passes_stream_arrow_rows():
    """The scans take bare Arrow batches: a segment's summary and states do not depend
    on how its rows are cut into batches, and other columns pass through untouched."""
    import pyarrow as pa
    from pitchline.operators import ewm
    rng = np.random.default_rng(3)
    n, specs, keys = 400, [("x", "e")], ["team"]
    x = [None if v < 0.3 else float(v) for v in rng.random(n)]
    x[40:90] = [None] * 50                                      # whole segments without a value
    team = [None if i < 20 else "A" if i < 210 else "B" for i in range(n)]
    seg = [i // 13 for i in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array(team), pa.array(seg), pa.array(x, pa.float64()), pa.array(range(n))], names=["team", "_seg", "x", "id"])
    sums = pa.schema([("team", pa.string()), ("_seg", pa.int64()), ("x__n_lead", pa.int64()), ("x__x1", pa.float64()),
                      ("x__P", pa.float64()), ("x__R", pa.float64()), ("x__g_end", pa.int64())])
    states = pa.schema([("team", pa.string()), ("_seg", pa.int64()), ("_y0_x", pa.float64()), ("_g0_x", pa.int64())])
    want = pd.Series(x, dtype="float64").groupby(pd.Series(team).fillna("-")).transform(
        lambda v: v.ewm(span=5, adjust=False).mean().shift(1)).to_numpy()
    for size in (1, 7, 1000):
        cut = lambda b: [b.slice(i, size) for i in range(0, b.num_rows, size)]
        plain = pa.Table.from_batches(ewm._scan(specs, 5, keys, False)(cut(rows))).to_pandas()
        np.testing.assert_allclose(plain.e, want, rtol=1e-12)
        assert plain.id.tolist() == list(range(n))
        summed = pa.Table.from_batches(ewm._segment_summary(specs, 5, keys, False, sums)(cut(rows)), sums).combine_chunks()
        assert summed.num_rows == len(set(zip(team, seg)))
        before = pa.Table.from_batches(ewm._incoming_states(specs, 5, keys, False, states)(cut(summed.to_batches()[0])), states).to_pandas()
        seeds = {(None if pd.isna(t) else t, s): (y, g) for t, s, y, g in before.itertuples(index=False)}
        y0, g0 = zip(*[seeds[k] for k in zip(team, seg)])
        seeded = pa.RecordBatch.from_arrays([*rows.columns, pa.array(y0, pa.float64(), from_pandas=True), pa.array(g0, pa.int64())],
                                            names=[*rows.schema.names, "_y0_x", "_g0_x"])
        got = pa.Table.from_batches(ewm._scan(specs, 5, [*keys, "_seg"], False, seeded=True)(cut(seeded)))
        assert got.column_names == ["team", "_seg", "x", "id", "e"]
        np.testing.assert_allclose(got.to_pandas().e, want, rtol=1e-12)


def test_momentum_second_route_keeps_no_copy_of_the_table(spark, sf_small):
    """It agrees with the features, and its segments come from the team window: no
    sorted copy of the whole table is written for them."""
    from pitchline.operators.momentum import LONG_FEATURES
    from pitchline.operators.quality import feature_mismatches, momentum_recomputed
    lt = long_table(matches(spark, sf_small).where("match_id % 5 = 0"))
    again = momentum_recomputed(lt)
    assert set(LONG_FEATURES) < set(again.columns)
    assert "LogicalRDD" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert again.count() == lt.count()
    assert feature_mismatches(long_features(lt), again, ["match_id", "is_home"], LONG_FEATURES).count() == 0


def test_features_carry_only_columns_that_are_read(spark, sf_small):
    """Names that the result lacks pass through neither exchange, scan nor written positions."""
    from pitchline.operators.momentum import match_features
    from pitchline.sources.tables import matches
    m = matches(spark, sf_small)
    for args in ({}, {"seg_rows": 211, "chunk_rows": 1000}):
        plan = match_features(m, **args)._jdf.queryExecution().optimizedPlan().toString()
        scans = [line for line in plan.splitlines() if "MapInArrow run(" in line and "match_density" in line]
        assert scans and not any("season" in line or "opponent#" in line for line in scans)
