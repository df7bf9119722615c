"""Edge cases of individual operators (FIXTURES section 4)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures import edge_matches


def test_season_parsing(spark):
    from pitchline.functions.parse import season_range, season_start_year, season_start_year_strict
    df = spark.createDataFrame([("2017-2018",), ("2017-2019",), ("junk",), (None,)], "s string")
    got = [r[0] for r in df.select(season_start_year("s")).collect()]
    assert got == [2017, None, None, None]
    r = spark.createDataFrame([("2019-2020", "2017-2018")], "a string, b string") \
        .select(season_range("a", "b").alias("x")).collect()[0][0]
    assert r == ["2017-2018", "2018-2019", "2019-2020"]
    with pytest.raises(Exception):
        df.select(season_start_year_strict("s")).collect()


def test_kickoff_formats(spark):
    from pitchline.functions.parse import parse_kickoff
    df = spark.createDataFrame([("Aug 18 2017 - 6:15pm",), ("Aug 8 2017 - 12:05AM",), ("nonsense",)], "s string")
    got = [r[0] for r in df.select(parse_kickoff("s").cast("string")).collect()]
    assert got == ["2017-08-18 18:15:00", "2017-08-08 00:05:00", None]


def test_money(spark):
    from pitchline.functions.parse import with_market_value
    df = spark.createDataFrame([("€1.20m",), ("€450k",), ("-",), ("€1,5m",), ("€1.10bn",), ("abc",), ("",)], "s string")
    got = [r[0] for r in with_market_value(df, "s", "v").select("v").collect()]
    assert got == [1.2e6, 450e3, None, 1.5e6, 1.1e9, None, None]


def test_team_key_accents(spark):
    from pitchline.functions.text import team_key_expr
    df = spark.createDataFrame([("Atlético de Madrid",), ("Deportivo Alavés",), ("Øre ß",)], "s string")
    assert [r[0] for r in df.select(team_key_expr("s")).collect()] == ["atleticodemadrid", "deportivoalaves", "re"]


def test_alias_override_and_single_hop(spark):
    from pitchline.operators.entity import alias_map, canonical_key
    rows = spark.createDataFrame([("Real Betis", "betis", 1), ("Club X", "atletico", 2)],
                                 "canonical_name string, variant_name string, ord long")
    amap = alias_map(spark, rows, order_col="ord")
    m = {r.variant_key: r.canonical_key for r in amap.collect()}
    assert m["betis"] == "realbetis"            # table row overrides the built-in group
    assert m["atletico"] == "clubx"
    assert m["athbilbao"] == "athleticclubbilbao"
    names = spark.createDataFrame([("Atletico",), ("Unknown FC",)], "n string")
    got = {r.n: r.team_key for r in canonical_key(names, "n", amap).collect()}
    assert got == {"Atletico": "clubx", "Unknown FC": "unknownfc"}


def test_many_to_one_guard(spark):
    from pitchline.operators.entity import ManyToOneViolation, assert_many_to_one
    df = spark.createDataFrame([("s", "a"), ("s", "a")], "season string, team_name string")
    with pytest.raises(ManyToOneViolation):
        assert_many_to_one(df, ["season", "team_name"])


def test_squad_without_players(spark):
    from pitchline.operators.entity import squad_values
    ts = spark.createDataFrame([("2019-2020", "1"), ("2019-2020", "2")], "season string, team_id string")
    pl = spark.createDataFrame([("2019-2020", "1", 5.0)], "season string, team_id string, player_market_value_eur double")
    got = {r.team_id: (r.squad_market_value_sum, r.player_count_with_value) for r in squad_values(ts, pl).collect()}
    assert got == {"1": (5.0, 1), "2": (None, 0)}


def test_elo_single_league_and_missing_goals(spark):
    from pitchline.operators.elo import elo_ratings
    e = {r.match_id: r for r in elo_ratings(edge_matches(spark)).collect()}
    assert e[1].home_elo_pre == 1500.0 and e[1].away_elo_pre == 1500.0
    assert abs(e[1].elo_home_win_prob_pre - 1 / (1 + 10 ** (-65 / 400))) < 1e-12
    # match 3 has no goals: counted as a home loss, so A loses rating before match 5
    assert e[5].home_elo_pre < e[3].home_elo_pre + 20
    assert e[12].home_elo_pre == 1500.0        # other league starts fresh


def test_clean_keeps_null_season(spark):
    from pitchline.operators.prep import clean_data
    df = spark.createDataFrame([("H", None), ("D", "2025-2026"), (None, "2019-2020"), ("A", "2019-2020")],
                               "target_match_result string, season string")
    assert df.transform(clean_data).count() == 2


def test_time_split_positions(spark):
    from pitchline.operators.splits import time_split
    df = spark.range(100).select(F.col("id").alias("match_id"),
                                 F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("kickoff"))
    s = {r.split: r["count"] for r in time_split(df).groupBy("split").count().collect()}
    assert s == {"train": 70, "val": 15, "test": 15}


def test_exact_medians(spark):
    from pitchline.operators.splits import exact_medians
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (3.0, 1.0), (10.0, 2.0)], "a double, b double")
    r = exact_medians(df, ["a", "b"]).collect()[0]
    assert r["a"] == 2.5 and r["b"] == 2.0


def test_no_pairs_above_limit(spark):
    from pitchline.operators.screening import correlation_groups, high_corr_pairs
    pairs = spark.createDataFrame([("a", "b", 0.1)], "feature_1 string, feature_2 string, correlation double")
    assert correlation_groups(high_corr_pairs(pairs)).count() == 0


def test_constant_column_correlation_is_null(spark):
    from pitchline.operators.screening import corr_pairs_all
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 2.0, 4.0), (1.0, 3.0, 6.1)], "c double, x double, y double")
    got = {(r.feature_1, r.feature_2): r.correlation for r in corr_pairs_all(df, ["c", "x", "y"]).collect()}
    assert got[("c", "x")] is None and got[("x", "y")] > 0.99


def test_metrics_zero_division(spark):
    from pitchline.operators.metrics import classification_metrics
    p = spark.createDataFrame([("m", "test", "H", "H", 0.8, 0.1, 0.1), ("m", "test", "D", "H", 0.6, 0.2, 0.2)],
                              "model string, split string, y_true string, y_pred string, p_H double, p_D double, p_A double")
    r = classification_metrics(p).collect()[0]
    assert r.accuracy == 0.5
    # labels seen: H (p=0.5, r=1, f1=2/3) and D (p=0 by 0/0, r=0, f1=0)
    assert abs(r.f1_macro - (2 / 3) / 2) < 1e-12 and abs(r.precision_macro - 0.25) < 1e-12


def test_csv_encoding_fallback_and_guard(spark, tmp_path):
    from pitchline.sources.io import MissingColumns, ensure_columns, read_csv
    p = tmp_path / "latin1.csv"
    p.write_bytes("team,goals\nAlavés,2\nCádiz,1\n".encode("latin-1"))
    df = read_csv(spark, str(p), "team string, goals int")
    assert sorted(r.team for r in df.collect()) == ["Alavés", "Cádiz"]
    with pytest.raises(MissingColumns):
        ensure_columns(df, ["team", "season"])


def test_csv_files_keep_their_own_encoding(spark, tmp_path):
    from pitchline.sources.io import read_csv
    (tmp_path / "a.csv").write_bytes("team,goals\nAlavés,2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("team,goals\nCádiz,1\nodd\ufffd,0\n".encode())
    assert sorted(r.team for r in read_csv(spark, str(tmp_path), "team string, goals int").collect()) == ["Alavés", "Cádiz", "odd\ufffd"]


def test_sorted_sink(spark):
    from pitchline.session import scratch_path
    from pitchline.sources.io import write_table
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k")).repartition(6)
    path = write_table(df, scratch_path(spark, "sorted"), sort_by=["k"])
    files = spark.read.parquet(path).select("k", F.col("_metadata.file_name").alias("f")).collect()
    assert [r.k for r in sorted(files, key=lambda r: r.f)] == list(range(100))


@pytest.mark.parametrize("seg_rows", [None, 16])
def test_weights_and_null_options(spark, seg_rows):
    import numpy as np
    import pandas as pd
    from pitchline.operators.long_table import long_table
    from pitchline.operators.momentum import long_features
    from pitchline.sources.tables import matches
    lt = long_table(matches(spark, "/root/testdata/sf0.001")).where("team = 'NATION_3'")
    got = long_features(lt, seg_rows, weights="restart", ignore_na=True).orderBy("kickoff", "match_id").toPandas()
    rows = lt.orderBy("kickoff", "match_id").toPandas()
    ewm = rows.odds_move_for.astype(float).ewm(span=5, adjust=False, ignore_na=True).mean().shift(1)
    np.testing.assert_allclose(got.odds_move_for_ewm_5.astype(float), ewm, rtol=1e-9, atol=1e-12)
    for i in range(len(rows)):
        v = [x for x in rows.odds_move_for[max(0, i - 5):i] if not pd.isna(x)]
        want = np.dot(v, range(1, len(v) + 1)) / sum(range(1, len(v) + 1)) if v else np.nan
        np.testing.assert_allclose(float(got.odds_move_for_mom_5[i]), want, rtol=1e-9, atol=1e-12)


def test_urls_and_model_info(spark):
    from pitchline.functions.text import competition_url, squad_url
    from pitchline.operators.models import model_info
    df = spark.range(1).select(competition_url(F.lit("https://h"), F.lit("laliga"), F.lit("ES1"), F.lit(2019)).alias("c"),
                               squad_url(F.lit("https://h"), F.lit("x"), F.lit("7"), F.lit(2019)).alias("s"))
    assert tuple(df.head()) == ("https://h/laliga/startseite/wettbewerb/ES1?saison_id=2019", "https://h/x/kader/verein/7/saison_id/2019")
    info = model_info("naive_bayes", ["a", "b"])
    assert info["uses_scaler"] and info["n_features"] == 2


def test_missing_path_is_an_error(spark, tmp_path):
    from pyspark.errors import AnalysisException
    from pitchline.sources.io import read_csv
    with pytest.raises(AnalysisException):
        read_csv(spark, str(tmp_path / "none.csv"), "a int").collect()


def test_report_roundtrip(spark):
    from pitchline.session import scratch_path
    from pitchline.sources.io import load_report, save_report
    path = save_report(spark, {"seasons": ["2019-2020"], "coverage_ratio": 0.5}, scratch_path(spark, "rep"))
    r = load_report(spark, path)
    assert r["coverage_ratio"] == 0.5 and r["seasons"] == ["2019-2020"] and "timestamp" in r


def test_squad_rows_inline_fixture(spark):
    from pitchline.operators.entity import squad_rows
    html = ('<table class="items"><tbody>'
            '<tr class="odd"><td>1</td><td><a href="/x/profil/spieler/9">Ana Pérez</a></td><td>€1.50m</td></tr>'
            '<tr class="even"><td></td><td>Bo Li</td><td>€300k</td></tr>'
            '<tr class="odd"><td>No Value</td><td>-</td></tr>'
            '<tr class="header"><td>skip</td><td>€9m</td></tr>'
            '</tbody></table>')
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = sorted((r.player_name, r.player_market_value_eur) for r in squad_rows(pages).collect())
    assert got == [("Ana Pérez", 1.5e6), ("Bo Li", 3e5)]


def test_skeleton_date_column_choice(spark):
    from pitchline.operators.entity import team_match_skeleton
    df = spark.createDataFrame([("2019-2020", "A", "B", "2020-01-05 18:00:00", "LaLiga"),
                                ("2019-2020", "A", "C", "2020-01-05 20:00:00", "other")],
                               "season string, home_team string, away_team string, match_datetime_utc string, league string")
    sk = team_match_skeleton(df, league="laliga", league_label="LaLiga").collect()
    assert sorted(r.team_name for r in sk) == ["A", "B"]


def test_exact_medians_many_values(spark):
    from pitchline.operators.splits import exact_medians
    df = spark.range(1001).select((F.col("id") * 1.5).alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                  F.lit(None).cast("double").alias("c"), F.lit(4.0).alias("d")).repartition(7)
    got = exact_medians(df, ["a", "b", "c", "d"]).collect()[0]
    ref = df.agg(F.median("a"), F.median("b")).collect()[0]
    assert (got["a"], got["b"], got["c"], got["d"]) == (ref[0], ref[1], None, 4.0)


def test_components_of_a_long_chain(spark):
    from pitchline.operators.graph import components
    got = components(spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "a", "b").collect()
    assert len(got) == 301 and {r["label"] for r in got} == {0}


def test_correlation_with_gaps_equals_pandas(spark):
    import numpy as np
    import pandas as pd
    from pitchline.operators.screening import corr_pairs_all
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 1e3
    a[rng.random(a.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(a, columns=list("abcd"))
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in a]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    want = pdf.corr()
    for r in corr_pairs_all(df, list("abcd")).collect():
        assert abs(r.correlation - want.loc[r.feature_1, r.feature_2]) < 1e-9


@pytest.mark.parametrize("span,gap", [(5, 3), (5, 4000), (2000, 5000)])
def test_ewm_continues_over_any_gap(span, gap):
    import numpy as np
    import pandas as pd
    from pitchline.operators.ewm import _after, _continued
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=40), np.full(gap, np.nan), rng.normal(size=30), [np.nan] * 5, rng.normal(size=5)])
    want = pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()
    alpha, y, g, got = 2 / (span + 1), float("nan"), 0, []
    for part in np.array_split(x, 17):
        states = _continued(y, g, part, alpha)
        got.extend(states)
        y, g = _after(y, g, part, states)
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_prior_ewm_orders_its_input(spark):
    import pandas as pd
    from pitchline.operators.ewm import with_prior_ewm
    rows = [(i, f"t{i % 3}", float(i * 7 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "match_id long, team string, x double").withColumn(
        "kickoff", F.timestamp_seconds(F.col("match_id") * 60).cast("timestamp_ntz")).orderBy(F.rand(1)).repartition(5)
    got = {r.match_id: r.e for r in with_prior_ewm(df, [("x", "e")], 4).collect()}
    for t in range(3):
        mine = [r for r in rows if r[1] == f"t{t}"]
        want = pd.Series([r[2] for r in mine]).ewm(span=4, adjust=False).mean().shift(1)
        for r, w in zip(mine, want):
            assert got[r[0]] is None if pd.isna(w) else abs(got[r[0]] - w) < 1e-12


@pytest.mark.parametrize("chunk_rows", [250_000, 2])
def test_elo_carries_over_between_leagues(spark, chunk_rows):
    from pitchline.operators.elo import elo_ratings
    rows = [(1, 0, "A", "B", 3, 0), (2, 0, "B", "C", 1, 1), (3, 1, "A", "D", 0, 1), (4, None, "D", "A", 2, 0), (5, 2, "X", None, 1, 0)]
    m = spark.createDataFrame(rows, "match_id long, league_id int, home_team string, away_team string, home_goals int, away_goals int").withColumn(
        "kickoff", F.timestamp_seconds(F.col("match_id") * 60).cast("timestamp_ntz"))
    got = {r.match_id: r for r in elo_ratings(m, chunk_rows=chunk_rows).collect()}
    ratings, want = {}, {}
    for i, _, h, a, hg, ag in rows:
        x, y = ratings.get(h, 1500.0), ratings.get(a, 1500.0)
        e = 1 / (1 + 10 ** ((y - x - 65) / 400))
        s = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
        want[i] = (x, y)
        ratings[h], ratings[a] = x + 20 * (s - e), y + 20 * (e - s)
    assert set(got) == set(want)
    for i, (x, y) in want.items():
        assert abs(got[i].home_elo_pre - x) < 1e-9 and abs(got[i].away_elo_pre - y) < 1e-9


def test_segmented_paths_keep_rows_without_team(spark, sf_small):
    from pitchline.operators.history import venue_history
    from pitchline.plans.registry import _odd_matches
    m = _odd_matches(spark, sf_small)
    a, b = (venue_history(m, seg_rows=s).orderBy("match_id").toPandas() for s in (None, 97))
    assert len(a) == m.count()
    import pandas as pd
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, rtol=1e-9)


def test_population_scaling_of_pipelines(spark):
    import numpy as np
    from pitchline.operators.models import fit, scaler
    df = spark.range(40).select("id", F.col("id").cast("double").alias("x"), F.lit(3.0).alias("c"),
                                F.when(F.col("id") % 3 == 0, "H").when(F.col("id") % 3 == 1, "D").otherwise("A").alias("target_match_result"))
    model = fit(df, ["x", "c"], "logistic_regression")
    v = df.orderBy("id").select(model.inputs().alias("v")).toPandas().v
    own = scaler(df, ["x", "c"])(df, ["id"]).orderBy("id").toPandas()
    np.testing.assert_allclose(np.stack(v)[:, 0], own.x, atol=1e-12)
    assert (own.c == 0).all() and abs(own.x.std(ddof=0) - 1) < 1e-12


def test_checkpoint_folder_is_required_on_a_cluster():
    from pitchline.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_feature_subsets_and_decoding(spark):
    from pitchline.operators.prep import clean_features, decode_label, encode_label
    df = spark.createDataFrame([("H", 1, 2.0, 3.0)], "r string, ht_result_encoded int, odds_open_home double, capacity double")
    assert clean_features(df, "minimal").columns == ["r", "odds_open_home", "capacity"]
    assert clean_features(df, "conservative").columns == ["r", "capacity"]
    assert clean_features(df, "aggressive").columns == ["capacity"]
    assert df.select(decode_label(encode_label("r")).alias("x")).head().x == "H"


def test_feature_mismatches_detects(spark):
    from pitchline.operators.quality import feature_mismatches
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0), (3, 1.0, 1.0)], "k long, x double, y double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, None), (2, 2.5, 3.0)], "k long, x double, y double")
    got = sorted((r.k, r.feature) for r in feature_mismatches(a, b, ["k"], ["x", "y"]).collect())
    assert got == [(2, "x"), (3, "x"), (3, "y")]


@pytest.mark.parametrize("step_rows, steps", [(1_000_000, 1), (8, 5)])
def test_elo_steps_do_not_multiply_with_chunks(spark, monkeypatch, step_rows, steps):
    import datetime as dt
    import glob
    from pitchline.operators import elo
    monkeypatch.setattr(elo, "STEP_ROWS", step_rows)
    rows = [(i, "L", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 2), f"t{i % 3}", f"t{(i + 1 + i % 2) % 3}" if i % 5 else None, i % 4, (i * 7) % 3) for i in range(40)]
    m = spark.createDataFrame(rows, "match_id long, league_id string, kickoff timestamp_ntz, home_team string, away_team string, home_goals long, away_goals long")
    made = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{made}/elo-out-*"))
    got = sorted(map(tuple, elo.elo_ratings(m, chunk_rows=2).collect()))
    paths = set(glob.glob(f"{made}/elo-out-*")) - before
    assert [len(glob.glob(f"{p}/_step=*")) for p in paths] == [steps]
    assert got == sorted(map(tuple, elo.elo_ratings(m).collect()))
