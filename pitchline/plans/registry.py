"""Named queries: ``(spark, sf_dir) -> DataFrame`` plus their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchline.plans import oracle_sql as osql
from pitchline.plans.common import finish
from pitchline.sources.tables import matches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql() if callable(sql) else sql
        return fn
    return deco


# ------------------------------------------------------------------ history
@register("venue_history", osql.venue_history_sql)
def q_venue_history(spark, sf_dir):
    from pitchline.operators.history import venue_history
    return finish(venue_history(matches(spark, sf_dir)))
FLAGSHIP = "match_features"


# ------------------------------------------------------------------ momentum and Elo
@register("elo_pre", osql.elo_sql)
def q_elo_pre(spark, sf_dir):
    from pitchline.operators.elo import elo_ratings
    return finish(elo_ratings(matches(spark, sf_dir)))


@register("long_features", osql.long_features_sql)
def q_long_features(spark, sf_dir):
    from pitchline.operators.elo import with_elo
    from pitchline.operators.long_table import long_table
    from pitchline.operators.momentum import LONG_FEATURES, long_features
    from pitchline.operators.segments import rows_per_segment
    m = matches(spark, sf_dir)
    lf = long_features(long_table(with_elo(m)), rows_per_segment(m))
    return finish(lf.select("match_id", "is_home", "team", *LONG_FEATURES))


@register("match_features", osql.match_features_sql)
def q_match_features(spark, sf_dir):
    from pitchline.operators.momentum import match_features
    return finish(match_features(matches(spark, sf_dir)))


# ------------------------------------------------------------------ base columns, long table
@register("match_flags", osql.match_flags_sql)
def q_match_flags(spark, sf_dir):
    from pitchline.operators.long_table import match_columns
    mc = match_columns(matches(spark, sf_dir))
    return finish(mc.select("match_id", "home_win", "home_draw", "home_loss", "away_win", "away_draw",
                            "away_loss", "home_goal_diff", "away_goal_diff", "home_win_margin",
                            "away_win_margin", "home_loss_margin", "away_loss_margin"))


@register("match_points", osql.match_points_sql)
def q_match_points(spark, sf_dir):
    from pitchline.operators.long_table import match_columns
    return finish(match_columns(matches(spark, sf_dir)).select("match_id", "home_points", "away_points"))


@register("long_table", osql.long_table_sql)
def q_long_table(spark, sf_dir):
    from pitchline.operators.long_table import long_table
    lt = long_table(matches(spark, sf_dir))
    return finish(lt.select("match_id", "team", "opponent", "is_home", "goals_for", "goals_against",
                            "points", "goal_diff", "xg_diff_proxy", "odds_move_for", "odds_move_abs_for",
                            "prob_shift_for", "travel_km_team", "opponent_ppg"))


# ------------------------------------------------------------------ parsing
def _ts_strings(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    ts = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440), F.col("o_orderdate"))
    k = F.col("o_orderkey") % 7
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    s = (F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("bad "), F.col("o_orderkey").cast("string")))
          .when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
          .when(k == 1, F.date_format(ts, "MMM d yyyy - h:mma"))
          .when(k == 2, F.date_format(ts, "yyyy-MM-dd"))
          .when(k == 3, F.concat(iso, F.lit("Z")))
          .when(k == 4, F.concat(iso, F.lit(".250")))
          .when(k == 5, F.concat(iso, F.lit("+02:00")))
          .otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm")))
    return o.select("o_orderkey", s.alias("raw"))


@register("parse_ts_mixed", osql.parse_ts_mixed_sql)
def q_parse_ts_mixed(spark, sf_dir):
    from pitchline.functions.parse import parse_ts_mixed
    d = _ts_strings(spark, sf_dir)
    return finish(d.select("o_orderkey", "raw", parse_ts_mixed("raw").alias("parsed")))


@register("parse_kickoff", osql.parse_kickoff_sql)
def q_parse_kickoff(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.functions.parse import parse_kickoff
    from pitchline.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    ts = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440), F.col("o_orderdate"))
    raw = F.when(F.col("o_orderkey") % 50 == 0, F.lit("n/a")).otherwise(F.date_format(ts, "MMM d yyyy - h:mma"))
    d = o.select("o_orderkey", raw.alias("raw"))
    return finish(d.select("o_orderkey", parse_kickoff("raw").alias("kickoff")))


@register("parse_date_fallback", osql.parse_date_fallback_sql)
def q_parse_date_fallback(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.functions.parse import parse_date_fallback
    from pitchline.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    d = o.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("raw"))
    return finish(parse_date_fallback(d, "raw").select("o_orderkey", "match_date"))


@register("coerce_numeric", osql.coerce_numeric_sql)
def q_coerce_numeric(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.functions.parse import coerce_numeric
    from pitchline.sources.tables import read_table
    p = read_table(spark, sf_dir, "part")
    raw = (F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string"))
            .when(F.col("p_partkey") % 6 == 1, F.col("p_brand"))
            .when(F.col("p_partkey") % 6 == 4, F.concat(F.col("p_size").cast("string"), F.lit("d")))
            .otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5"))))
    return finish(p.select("p_partkey", coerce_numeric(raw).alias("value")))


@register("season_year", osql.season_year_sql)
def q_season_year(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.functions.parse import season_start_year
    m = matches(spark, sf_dir)
    bad = F.concat(F.substring("season", 1, 5), ((F.substring("season", 1, 4)).try_cast("int") + 2).cast("string"))
    s = m.select(F.when(F.col("match_id") % 11 == 0, bad).otherwise(F.col("season")).alias("season")).distinct()
    return finish(s.select("season", season_start_year("season").alias("start_year")))


@register("season_range", osql.season_range_sql)
def q_season_range(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.functions.parse import season_range
    m = matches(spark, sf_dir)
    b = m.groupBy("league_id").agg(F.min("season").alias("first"), F.max("season").alias("last"))
    # bounds passed reversed on purpose: the range swaps them
    return finish(b.select("league_id", F.explode(season_range("last", "first")).alias("season")))


@register("market_value", osql.market_value_sql)
def q_market_value(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.functions.parse import with_market_value
    from pitchline.sources.tables import read_table
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    sz = F.col("p_size").cast("string")
    raw = (F.when(k == 0, F.concat(F.lit("€"), sz, F.lit(".20m")))
            .when(k == 1, F.concat(F.lit("€"), sz, F.lit("50k")))
            .when(k == 2, F.lit("-"))
            .when(k == 3, F.concat(F.lit("€"), sz, F.lit(",5m")))
            .when(k == 4, F.concat(F.lit("€1."), sz, F.lit("bn")))
            .when(k == 5, F.concat(F.lit("€"), sz, F.lit("d")))
            .otherwise(F.lit(" ")))
    d = p.select("p_partkey", raw.alias("raw"))
    return finish(with_market_value(d, "raw", "value_eur"))


@register("url_template", osql.url_template_sql)
def q_url_template(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.functions.text import squad_url
    from pitchline.sources.standins import team_seasons
    from pitchline.operators.entity import team_match_skeleton
    ts = team_seasons(spark, sf_dir, team_match_skeleton(matches(spark, sf_dir)))
    return finish(ts.select("season", "team_id",
                            squad_url(F.lit("https://squads.example"), "slug", "team_id", "tm_season_id").alias("url")))


# ------------------------------------------------------------------ entity resolution
@register("team_key", osql.team_key_sql)
def q_team_key(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.functions.text import with_team_key
    from pitchline.sources.tables import read_table
    d = read_table(spark, sf_dir, "documents")
    words = d.select(F.explode(F.split(F.col("text"), r"\s+")).alias("name")).where(F.col("name") != "").distinct()
    return with_team_key(words, "name")


@register("alias_map", osql.alias_map_sql)
def q_alias_map(spark, sf_dir):
    from pitchline.operators.entity import alias_map
    from pitchline.sources.standins import alias_table
    return alias_map(spark, alias_table(spark, sf_dir), order_col="row_no")


@register("canonical_team", osql.canonical_team_sql)
def q_canonical_team(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.operators.entity import alias_map, canonical_key
    from pitchline.sources.standins import alias_table
    from pitchline.sources.tables import read_table
    amap = alias_map(spark, alias_table(spark, sf_dir), order_col="row_no")
    sides = matches(spark, sf_dir).select(F.explode(F.array("home_team", "away_team")).alias("name"))
    names = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(sides).distinct()
    return canonical_key(names, "name", amap)


@register("page_links", osql.page_links_sql)
def q_page_links(spark, sf_dir):
    from pitchline.operators.entity import page_links
    from pitchline.sources.tables import read_table
    return finish(page_links(read_table(spark, sf_dir, "pages")))


@register("team_links", osql.team_links_sql)
def q_team_links(spark, sf_dir):
    from pitchline.operators.entity import team_links
    from pitchline.sources.standins import competition_pages
    return finish(team_links(competition_pages(spark, sf_dir)))


@register("squad_rows", osql.squad_rows_sql)
def q_squad_rows(spark, sf_dir):
    from pitchline.operators.entity import squad_rows
    from pitchline.sources.standins import squad_pages
    return finish(squad_rows(squad_pages(spark, sf_dir)))


def _enrichment(spark, sf_dir):
    from pitchline.operators import entity as E
    from pitchline.sources import standins as S
    master = S.master_matches(spark, sf_dir)
    # read by team-seasons, master names, two m:1 checks and the final join
    skel = E.team_match_skeleton(master, league_label="ALL").checkpoint(eager=True)
    meta = S.team_seasons(spark, sf_dir, skel)
    players = S.player_values(spark, sf_dir, meta)
    amap = E.alias_map(spark, S.alias_table(spark, sf_dir), order_col="row_no")
    squad = E.squad_values(meta, players)
    resolved = E.resolve_teams(skel, squad, amap)
    squad_out = resolved.select("season", F_col("resolved_team_name").alias("team_name"), "tm_team_name",
                                "tm_season_id", "team_id", "slug", "player_count_with_value",
                                "squad_market_value_sum")
    merged = E.skeleton_with_value(skel, squad_out)
    return dict(master=master, skeleton=skel, meta=meta, players=players, amap=amap, squad=squad,
                resolved=resolved, squad_out=squad_out, merged=merged,
                unresolved=E.unresolved_teams(resolved))


def F_col(c):
    from pyspark.sql import functions as F
    return F.col(c)


@register("skeleton", osql.skeleton_sql)
def q_skeleton(spark, sf_dir):
    from pitchline.operators.entity import team_match_skeleton
    from pitchline.sources.standins import master_matches
    return finish(team_match_skeleton(master_matches(spark, sf_dir), league_label="ALL"))


@register("filter_league", osql.filter_league_sql)
def q_filter_league(spark, sf_dir):
    from pitchline.operators.entity import team_match_skeleton
    from pitchline.sources.standins import master_matches
    return finish(team_match_skeleton(master_matches(spark, sf_dir), league="europe", league_label="EUROPE"))


@register("squad_value", osql.squad_value_sql)
def q_squad_value(spark, sf_dir):
    e = _enrichment(spark, sf_dir)
    return finish(e["squad"].select("season", "team_id", "tm_team_name", "player_count_with_value",
                                    "squad_market_value_sum"))


@register("resolve_teams", osql.resolve_teams_sql)
def q_resolve_teams(spark, sf_dir):
    e = _enrichment(spark, sf_dir)
    return finish(e["resolved"].select("season", "team_id", "tm_team_name", "team_key", "team_name",
                                       "resolved_team_name"))


@register("unresolved_teams", osql.unresolved_teams_sql)
def q_unresolved_teams(spark, sf_dir):
    e = _enrichment(spark, sf_dir)
    return finish(e["unresolved"].select("season", "team_id", "tm_team_name", "team_key"))


@register("skeleton_with_value", osql.skeleton_with_value_sql)
def q_skeleton_with_value(spark, sf_dir):
    e = _enrichment(spark, sf_dir)
    return finish(e["merged"].select("league", "season", "match_date", "team_name", "squad_market_value_sum",
                                     "team_id"))


@register("duplicate_keys", osql.duplicate_keys_sql)
def q_duplicate_keys(spark, sf_dir):
    from pitchline.operators.entity import duplicate_keys
    from pitchline.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    return finish(duplicate_keys(li, ["l_orderkey", "l_linenumber"]))


@register("coverage", osql.coverage_sql)
def q_coverage(spark, sf_dir):
    from pitchline.operators.entity import coverage_report
    e = _enrichment(spark, sf_dir)
    return finish(coverage_report(e["master"], e["skeleton"], e["meta"], e["squad_out"], e["players"],
                                  e["unresolved"], e["merged"]))


# ------------------------------------------------------------------ preparation and splits
def _ht_clean(spark, sf_dir):
    from pitchline.operators.prep import clean_data, preprocess
    from pitchline.sources.training import halftime_table
    return clean_data(preprocess(halftime_table(spark, sf_dir)))


def _ht_split(spark, sf_dir):
    from pitchline.operators.splits import split_labels
    return split_labels(_ht_clean(spark, sf_dir), ["date_GMT", "match_id"])


def _ht_stored(spark, sf_dir):
    """Keys, target and numeric features of the cleaned half-time rows, written
    under the checkpoint folder."""
    from pitchline.operators.prep import encode_ht_result
    from pitchline.session import scratch_path
    names = ["match_id", "date_GMT", "target_match_result", *HT_NUMERIC]
    path = scratch_path(spark, "half-time")
    x = encode_ht_result(_ht_clean(spark, sf_dir)).select(*[f"`{c}`" for c in names])
    x.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    return spark.read.parquet(path).toDF(*names)


def _ht_x(spark, sf_dir):
    from pitchline.operators.prep import encode_ht_result, halftime_feature_columns
    s = _ht_split(spark, sf_dir)
    return encode_ht_result(s.select("match_id", "split", "target_match_result",
                                     *[f"`{c}`" for c in halftime_feature_columns(s) if c not in ("pos", "split")]))


@register("clean_data", osql.clean_data_sql)
def q_clean_data(spark, sf_dir):
    from pitchline.operators.prep import clean_data
    from pitchline.sources.training import halftime_table
    return clean_data(halftime_table(spark, sf_dir), ["1996-1997"]).select("match_id", "season", "target_match_result")


@register("filter_seasons", osql.filter_seasons_sql)
def q_filter_seasons(spark, sf_dir):
    from pitchline.operators.prep import filter_seasons
    from pitchline.sources.training import halftime_table
    return filter_seasons(halftime_table(spark, sf_dir), ["1995-1996", "1997-1998"]).select("match_id", "season")


@register("time_split", osql.time_split_sql)
def q_time_split(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.operators.splits import time_split
    keys = _ht_clean(spark, sf_dir).select("match_id", "date_GMT")
    split = time_split(keys, [F.col("date_GMT").asc_nulls_last(), F.col("match_id").asc()])
    return finish(split.select("match_id", "pos", "split"))


@register("walk_forward", osql.walk_forward_sql)
def q_walk_forward(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.operators.splits import walk_forward
    wf = walk_forward(_ht_clean(spark, sf_dir).select("match_id", "date_GMT"), 5, [F.col("date_GMT").asc_nulls_last(), F.col("match_id").asc()])
    return finish(wf.select("match_id", "pos", "fold_size", "train_from_fold", "val_fold"))


@register("split_counts", osql.split_counts_sql)
def q_split_counts(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.operators.prep import value_counts
    s = _ht_split(spark, sf_dir)
    a = value_counts(s, ["split"], "season").select("split", F.lit("season").alias("kind"),
                                                     F.col("season").alias("value"), "n")
    b = value_counts(s, ["split"], "target_match_result").select("split", F.lit("class").alias("kind"),
                                                                  F.col("target_match_result").alias("value"), "n")
    return a.unionByName(b)


@register("class_dist", osql.class_dist_sql)
def q_class_dist(spark, sf_dir):
    from pitchline.operators.prep import class_distribution
    return finish(class_distribution(_ht_clean(spark, sf_dir)))


@register("season_dist", osql.season_dist_sql)
def q_season_dist(spark, sf_dir):
    from pitchline.operators.prep import season_distribution
    return finish(season_distribution(_ht_clean(spark, sf_dir)))


@register("split_ranges", osql.split_ranges_sql)
def q_split_ranges(spark, sf_dir):
    from pitchline.operators.prep import split_ranges
    return split_ranges(_ht_split(spark, sf_dir))


@register("label_encode", osql.label_encode_sql)
def q_label_encode(spark, sf_dir):
    from pitchline.operators.prep import encode_label
    s = _ht_clean(spark, sf_dir)
    return finish(s.select("match_id", "target_match_result", encode_label("target_match_result").alias("label")))


@register("prematch_projection", osql.prematch_projection_sql)
def q_prematch_projection(spark, sf_dir):
    from pitchline.operators.prep import prematch_feature_columns
    from pitchline.sources.training import halftime_table
    t = halftime_table(spark, sf_dir)
    return finish(t.select("match_id", *[f"`{c}`" for c in prematch_feature_columns(t)]))


@register("halftime_projection", osql.halftime_projection_sql)
def q_halftime_projection(spark, sf_dir):
    from pitchline.operators.prep import halftime_feature_columns
    from pitchline.sources.training import halftime_table
    t = halftime_table(spark, sf_dir)
    return finish(t.select("match_id", *[f"`{c}`" for c in halftime_feature_columns(t)]))


@register("feature_subset", osql.feature_subset_sql)
def q_feature_subset(spark, sf_dir):
    from pitchline.operators.prep import clean_features
    from pitchline.sources.training import halftime_table
    return finish(clean_features(halftime_table(spark, sf_dir), "aggressive", keep=["match_id"]))


@register("feature_subset_modes", osql.feature_subset_modes_sql)
def q_feature_subset_modes(spark, sf_dir):
    """Columns that each mode keeps, with their filled values."""
    from pyspark.sql import functions as F
    from pitchline.operators.prep import clean_features, encode_ht_result
    from pitchline.sources.training import halftime_table
    x, out = encode_ht_result(halftime_table(spark, sf_dir)), None
    for mode in ("aggressive", "conservative", "minimal", "none"):
        kept = clean_features(x, mode)
        one = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(kept.columns)])).alias("f")
        part = kept.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(kept.columns)]).select(F.lit(mode).alias("mode"), one).select("mode", "f.*")
        out = part if out is None else out.unionByName(part)
    return finish(out)


@register("skeleton_date_columns", osql.skeleton_date_columns_sql)
def q_skeleton_date_columns(spark, sf_dir):
    """P5: a master table dates its matches by the first of the known columns
    that it has, whatever comes after it."""
    from pyspark.sql import functions as F
    from pitchline.operators.entity import SKELETON_DATE_COLUMNS, team_match_skeleton
    m, out = matches(spark, sf_dir).select("season", "home_team", "away_team", "kickoff"), None
    for i, name in enumerate(SKELETON_DATE_COLUMNS):
        later = [F.timestamp_add("DAY", F.lit(j + 1), F.col("kickoff")).alias(c) for j, c in enumerate(SKELETON_DATE_COLUMNS[i + 1:])]
        part = team_match_skeleton(m.select("season", "home_team", "away_team", *reversed(later), F.col("kickoff").alias(name)), league_label=name)
        out = part if out is None else out.unionByName(part)
    return finish(out)


def _impute(strategy):
    def q(spark, sf_dir):
        """A4 with fill values of the training split."""
        from pitchline.operators.prep import handle_missing_values
        x = _ht_x(spark, sf_dir).drop("target_match_result")
        train = x.where("split = 'train'").drop("split")
        return finish(handle_missing_values(x.drop("split"), strategy, train, keep=["match_id"]))
    return q


@register("impute_per_split", osql.impute_per_split_sql)
def q_impute_per_split(spark, sf_dir):
    """A4 with every split filled from itself."""
    from pitchline.operators.prep import handle_missing_per_split
    x = _ht_x(spark, sf_dir).drop("target_match_result")
    return finish(handle_missing_per_split(x, "median", keep=["match_id"]))


for _s in ("median", "mean", "zero"):
    register(f"impute_{_s}", (lambda s: lambda: osql.impute_sql(s))(_s))(_impute(_s))


@register("standardize", osql.standardize_sql)
def q_standardize(spark, sf_dir):
    from pitchline.operators.prep import numeric_columns, standardize
    x = _ht_x(spark, sf_dir).drop("target_match_result")
    train = x.where("split = 'train'")
    return finish(standardize(x, [c for c in numeric_columns(x) if c != "match_id"], train, keep=["match_id"]))


@register("class_weights", osql.class_weights_sql)
def q_class_weights(spark, sf_dir):
    from pyspark.sql import functions as F
    from pitchline.operators.prep import class_weights
    return finish(class_weights(_ht_split(spark, sf_dir).where(F.col("split") == "train")))


# ------------------------------------------------------------------ screening
HT_NUMERIC = osql.HT_NUMERIC


def _xt(spark, sf_dir):
    """Training-split feature matrix, median-imputed with training medians."""
    from pyspark.sql import functions as F
    from pitchline.operators.prep import encode_label, handle_missing_values
    x = _ht_x(spark, sf_dir).where(F.col("split") == "train")
    x = x.select("match_id", encode_label("target_match_result").alias("lbl"), *[f"`{c}`" for c in HT_NUMERIC])
    # materialised once: means, sums, variances and importances all scan it
    return handle_missing_values(x, "median", keep=["match_id", "lbl"]).checkpoint(eager=True)


def _pairs(spark, sf_dir):
    from pitchline.operators.screening import corr_pairs_all
    return corr_pairs_all(_xt(spark, sf_dir), HT_NUMERIC).checkpoint(eager=True)  # p(p-1)/2 rows


def _importance(spark, sf_dir, x=None):
    from pitchline.operators.screening import target_correlation
    return target_correlation(x if x is not None else _xt(spark, sf_dir), HT_NUMERIC, "lbl")


@register("corr_matrix", osql.corr_matrix_sql)
def q_corr_matrix(spark, sf_dir):
    return finish(_pairs(spark, sf_dir))


@register("corr_pairs", osql.corr_pairs_sql)
def q_corr_pairs(spark, sf_dir):
    from pitchline.operators.screening import high_corr_pairs
    return finish(high_corr_pairs(_pairs(spark, sf_dir)))


@register("low_variance", osql.low_variance_sql)
def q_low_variance(spark, sf_dir):
    from pitchline.operators.screening import low_variance
    return finish(low_variance(_xt(spark, sf_dir), HT_NUMERIC))


@register("redundant_features", osql.redundant_features_sql)
def q_redundant_features(spark, sf_dir):
    from pitchline.operators.screening import redundant_features
    return redundant_features(_pairs(spark, sf_dir))


def _groups(spark, sf_dir, pairs=None):
    from pitchline.operators.screening import correlation_groups, high_corr_pairs
    return correlation_groups(high_corr_pairs(pairs if pairs is not None else _pairs(spark, sf_dir)))


@register("corr_groups", osql.corr_groups_sql)
def q_corr_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@register("corr_keep_drop", osql.corr_keep_drop_sql)
def q_corr_keep_drop(spark, sf_dir):
    from pitchline.operators.screening import corr_pairs_all, keep_drop
    x = _xt(spark, sf_dir)
    pairs = corr_pairs_all(x, HT_NUMERIC).checkpoint(eager=True)
    return finish(keep_drop(_groups(spark, sf_dir, pairs), _importance(spark, sf_dir, x)))


@register("kept_features", osql.kept_features_sql)
def q_kept_features(spark, sf_dir):
    from pitchline.operators.screening import corr_pairs_all, keep_drop, kept_features
    x = _xt(spark, sf_dir)
    pairs = corr_pairs_all(x, HT_NUMERIC).checkpoint(eager=True)
    imp = _importance(spark, sf_dir, x)
    return kept_features(imp.select("feature"), keep_drop(_groups(spark, sf_dir, pairs), imp))


@register("top_features", osql.top_features_sql)
def q_top_features(spark, sf_dir):
    from pitchline.operators.screening import top_features
    return finish(top_features(_importance(spark, sf_dir), 10))


@register("corr_submatrix", osql.corr_submatrix_sql)
def q_corr_submatrix(spark, sf_dir):
    from pitchline.operators.screening import corr_submatrix
    return finish(corr_submatrix(_pairs(spark, sf_dir)))


@register("screening_report", osql.screening_report_sql)
def q_screening_report(spark, sf_dir):
    from pitchline.operators.screening import screening_report
    x = _xt(spark, sf_dir)
    return screening_report(x, HT_NUMERIC, _importance(spark, sf_dir, x), 5)


@register("corr_with_gaps", osql.corr_with_gaps_sql)
def q_corr_with_gaps(spark, sf_dir):
    """A6 on columns with missing values: every pair over its common rows."""
    from pyspark.sql import functions as F
    from pitchline.operators.screening import corr_pairs_all
    x = matches(spark, sf_dir)
    cols = ["home_goals", "away_goals", "odds_move_home", "odds_move_away", "travel_km"]
    return finish(corr_pairs_all(x.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols))


@register("component_chain", osql.component_chain_sql)
def q_component_chain(spark, sf_dir):
    """G3 on long chains: order keys linked to the next one in their block of
    500 make one component per block."""
    from pyspark.sql import functions as F
    from pitchline.operators.graph import components
    from pitchline.sources.tables import read_table
    k = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    e = k.where(F.col("a") % 500 != 499).select("a", (F.col("a") + 1).alias("b"))
    return finish(components(e, "a", "b"))


# ------------------------------------------------------------------ metrics
def _preds(spark, sf_dir):
    from pitchline.sources.predictions import predictions
    return predictions(spark, sf_dir)


@register("confusion", osql.confusion_sql)
def q_confusion(spark, sf_dir):
    from pitchline.operators.metrics import confusion_matrix
    return finish(confusion_matrix(_preds(spark, sf_dir)))


@register("class_metrics", osql.class_metrics_sql)
def q_class_metrics(spark, sf_dir):
    from pitchline.operators.metrics import classification_metrics
    return finish(classification_metrics(_preds(spark, sf_dir)))


@register("per_class_metrics", osql.per_class_metrics_sql)
def q_per_class_metrics(spark, sf_dir):
    from pitchline.operators.metrics import per_class_metrics
    return finish(per_class_metrics(_preds(spark, sf_dir)))


@register("log_loss", osql.log_loss_sql)
def q_log_loss(spark, sf_dir):
    from pitchline.operators.metrics import log_loss
    return finish(log_loss(_preds(spark, sf_dir)))


@register("best_model", osql.best_model_sql)
def q_best_model(spark, sf_dir):
    from pitchline.operators.metrics import best_model, classification_metrics
    p = _preds(spark, sf_dir)
    return finish(best_model(classification_metrics(p), p.select("model", "model_ord").distinct()))


@register("overfit_status", osql.overfit_status_sql)
def q_overfit_status(spark, sf_dir):
    from pitchline.operators.metrics import classification_metrics, overfit_status
    return finish(overfit_status(classification_metrics(_preds(spark, sf_dir))))


@register("model_comparison", osql.model_comparison_sql)
def q_model_comparison(spark, sf_dir):
    from pitchline.operators.metrics import model_comparison
    return finish(model_comparison(_preds(spark, sf_dir)))


@register("metrics_pivot", osql.metrics_pivot_sql)
def q_metrics_pivot(spark, sf_dir):
    from pitchline.operators.metrics import classification_metrics, metrics_long, metrics_pivot
    return finish(metrics_pivot(metrics_long(classification_metrics(_preds(spark, sf_dir)))))


# ------------------------------------------------------------------ models
def _model_data(spark, sf_dir):
    """Half-time feature matrix for all splits, imputed with training medians;
    the derived rows are written once, before split and medians read them."""
    from pyspark.sql import functions as F
    from pitchline.operators.prep import imputation_values, impute
    from pitchline.operators.splits import split_labels
    x = split_labels(_ht_stored(spark, sf_dir), ["date_GMT", "match_id"])
    fill = imputation_values(x.where(F.col("split") == "train"), HT_NUMERIC, "median")
    fill = spark.createDataFrame([tuple(fill.head())], fill.schema)                         # one row
    xi = impute(x, HT_NUMERIC, fill, keep=["match_id", "split", "target_match_result"])
    return {"all": xi} | {s: xi.where(F.col("split") == s) for s in ("train", "val", "test")}


def _nb_sql():
    return osql.gaussian_nb_sql()


@register("gaussian_nb", _nb_sql)
def q_gaussian_nb(spark, sf_dir):
    from pitchline.operators.models import gaussian_nb_fit, gaussian_nb_params, gaussian_nb_predict, scaler
    d = _model_data(spark, sf_dir)
    scaled = scaler(d["train"], HT_NUMERIC)
    stats = gaussian_nb_params(gaussian_nb_fit(scaled(d["train"], ("match_id", "target_match_result")), HT_NUMERIC))
    every = scaled(d["all"], ("match_id", "split"))
    p = gaussian_nb_predict(every, stats, HT_NUMERIC, ("match_id", "split"))
    return finish(p.select("match_id", "split", "y_pred", "p_H", "p_D", "p_A"))


def _train_query(model_type):
    def run(spark, sf_dir):
        from pitchline.operators.models import fit, predict
        d = _model_data(spark, sf_dir)
        m = fit(d["train"], HT_NUMERIC, model_type)
        return predict(m, d["all"], ("match_id", "split", "target_match_result"))
    return run


for _m in ("random_forest", "logistic_regression", "xgboost", "svm", "fnn"):
    register(f"train_{_m}")(_train_query(_m))


@register("model_roundtrip", osql.model_roundtrip_sql)
def q_model_roundtrip(spark, sf_dir):
    """A saved and loaded pipeline predicts as before, row by row."""
    from pyspark.sql import functions as F
    from pitchline.operators.models import fit, load_model, predict, save_model
    from pitchline.session import scratch_path
    d = _model_data(spark, sf_dir)
    model = fit(d["train"], HT_NUMERIC, "logistic_regression")
    loaded = load_model(spark, save_model(spark, model, scratch_path(spark, "model")))
    a, b = (predict(m, d["all"], ("match_id", "split")) for m in (model, loaded))
    b = b.select("match_id", *[F.col(c).alias(f"{c}_loaded") for c in ("y_pred", "p_H", "p_D", "p_A")])
    same = F.col("y_pred") == F.col("y_pred_loaded")
    for c in ("p_H", "p_D", "p_A"):
        same = same & (F.col(c) == F.col(f"{c}_loaded"))
    one = F.abs(F.col("p_H") + F.col("p_D") + F.col("p_A") - 1) < 1e-9
    return finish(a.join(b, "match_id").select("match_id", "split", same.alias("same"), one.alias("sums_to_one")))


@register("trained_comparison")
def q_trained_comparison(spark, sf_dir):
    """E1 + E3 on trained models: metrics per model and split, long form; a model
    that failed has one row, whose metric is the error."""
    from pyspark.sql import functions as F
    from pitchline.operators.metrics import classification_metrics, metrics_long
    from pitchline.operators.models import compare_models
    d = _model_data(spark, sf_dir)
    preds, _, status = compare_models(d["train"], {"train": d["train"], "val": d["val"], "test": d["test"]}, HT_NUMERIC)
    failed = status.where("stage <> 'done'").select("model", F.col("stage").alias("split"), F.col("message").alias("metric"), F.lit(None).cast("double").alias("value"))
    return failed if preds is None else metrics_long(classification_metrics(preds)).unionByName(failed)


@register("importance_avg")
def q_importance_avg(spark, sf_dir):
    """Mean importance over the models that expose one."""
    from pitchline.operators.models import feature_importance, fit, importance_frame
    from pitchline.operators.screening import average_importance
    d = _model_data(spark, sf_dir)
    frames = []
    for mt in ("random_forest", "logistic_regression", "xgboost", "svm"):
        frames.append(importance_frame(spark, mt, feature_importance(fit(d["train"], HT_NUMERIC, mt), HT_NUMERIC)))
    allf = frames[0]
    for f in frames[1:]:
        allf = allf.unionByName(f)
    return average_importance(allf)


@register("select_by_importance")
def q_select_by_importance(spark, sf_dir):
    """Forest (100 trees, depth 5) importances, top 30."""
    from pitchline.operators.models import feature_importance, fit, importance_frame
    from pitchline.operators.screening import top_features
    d = _model_data(spark, sf_dir)
    m = fit(d["train"], HT_NUMERIC, "random_forest", {"max_depth": 5, "class_weight": None})
    return top_features(importance_frame(spark, "random_forest", feature_importance(m, HT_NUMERIC)), 30)


# ------------------------------------------------------------------ quality
@register("first_match", osql.first_match_sql)
def q_first_match(spark, sf_dir):
    from pitchline.operators.long_table import long_table
    from pitchline.operators.quality import first_matches
    return first_matches(long_table(matches(spark, sf_dir)), ["team"]).select("team", "match_id")


@register("match_order", osql.match_order_sql)
def q_match_order(spark, sf_dir):
    from pitchline.operators.splits import positional_index
    return positional_index(matches(spark, sf_dir).select("match_id", "kickoff")).select("match_id", "pos")


@register("last_n_matches", osql.last_n_matches_sql)
def q_last_n_matches(spark, sf_dir):
    from pitchline.operators.long_table import long_table
    from pitchline.operators.splits import tail_rows
    return tail_rows(long_table(matches(spark, sf_dir)), ["team"], 5).select("team", "match_id")


@register("range_checks", osql.range_checks_sql)
def q_range_checks(spark, sf_dir):
    from pitchline.operators.history import venue_history
    from pitchline.operators.quality import range_checks
    return range_checks(venue_history(matches(spark, sf_dir)))


@register("first_match_checks", osql.first_match_checks_sql)
def q_first_match_checks(spark, sf_dir):
    from pitchline.operators.history import venue_history
    from pitchline.operators.long_table import long_table
    from pitchline.operators.momentum import long_features
    from pitchline.operators.quality import first_match_checks
    m = matches(spark, sf_dir)
    return first_match_checks(m, venue_history(m), long_features(long_table(m)))


@register("feature_mismatches", osql.feature_mismatches_sql)
def q_feature_mismatches(spark, sf_dir):
    """E4 on venue features with planted errors: exactly those are found."""
    from pyspark.sql import functions as F
    from pitchline.operators.history import VENUE_FEATURES, venue_history_long
    from pitchline.operators.long_table import long_table
    from pitchline.operators.quality import feature_mismatches, planted, venue_history_recomputed
    m = matches(spark, sf_dir)
    actual = planted(venue_history_long(long_table(m)), 101, "match_id", "goals_for", F.col("goals_for") + 1)
    actual = planted(actual, 103, "match_id", "win_rate", F.lit(None))
    return finish(feature_mismatches(actual, venue_history_recomputed(m), ["match_id", "is_home"], VENUE_FEATURES))


@register("diff_checks", osql.diff_checks_sql)
def q_diff_checks(spark, sf_dir):
    """E7 with planted errors in every difference column."""
    from pyspark.sql import functions as F
    from pitchline.operators.momentum import DIFF_PAIRS, match_features
    from pitchline.operators.quality import diff_checks, planted
    mf = match_features(matches(spark, sf_dir))
    for i, (d, _) in enumerate(DIFF_PAIRS):
        mf = planted(mf, 50 + i, "match_id", d, F.col(d) + 1)
    return finish(diff_checks(mf, DIFF_PAIRS))


# ------------------------------------------------------------------ window operators one by one
VENUE_SUBSETS = {
    "prior_count": ["matches_before"],                                   # W1
    "wins_last5": ["wins_last5"],                                        # W3
    "venue_rates": ["win_rate", "draw_rate", "loss_rate"],               # W4
    "venue_goals": ["goals_for", "goals_against", "goal_diff",
                    "goals_for_pm", "goals_against_pm", "goal_diff_pm"],  # W5
    "venue_margins": ["win_margin_avg", "loss_margin_avg"],              # W6
}
LONG_SUBSETS = {
    "form_points": ["form_pts_3", "form_pts_5", "form_pts_8"],                           # W8
    "wavg_k": ["goal_diff_5", "xg_diff_5_proxy", "odds_move_for_mom_3", "odds_move_for_mom_5",
               "odds_move_abs_for_mom_5", "implied_prob_shift_for_mom_5", "travel_km_mom_5"],  # W8
    "ewm_span5": ["odds_move_for_ewm_5", "implied_prob_shift_for_ewm_5", "travel_km_ewm_5"],  # W9
    "volatility5": ["mom_volatility_5"],                                                 # W10
    "venue_form": ["venue_form_pts_5", "venue_xg_diff_5_proxy"],                         # W11
    "rest_days": ["rest_days"],                                                          # W12
    "match_density": ["match_density"],                                                  # W13
    "fatigue": ["fatigue_adjusted_form", "travel_fatigue_score"],                        # W14
    "mom_slope": ["mom_slope"],                                                          # W15
    "density_momentum": ["match_density_mom_5", "match_density_ewm_5", "travel_fatigue_mom_5"],  # W16
    "opp_adj_form": ["opp_adj_form_5"],                                                  # W17
    "opp_adj_form_elo": ["opp_adj_form_5_elo"],                                          # W18
}


def _venue_subset(cols):
    def run(spark, sf_dir):
        from pitchline.operators.history import venue_history
        vh = venue_history(matches(spark, sf_dir))
        return finish(vh.select("match_id", *[f"{s}_{c}" for s in ("home", "away") for c in cols]))
    return run


def _long_subset(cols):
    def run(spark, sf_dir):
        from pitchline.operators.elo import with_elo
        from pitchline.operators.long_table import long_table
        from pitchline.operators.momentum import long_features
        lf = long_features(long_table(with_elo(matches(spark, sf_dir))))
        return finish(lf.select("match_id", "is_home", "team", *cols))
    return run


for _n, _c in VENUE_SUBSETS.items():
    register(_n, (lambda c: lambda: osql.venue_history_sql(cols=c))(_c))(_venue_subset(_c))
for _n, _c in LONG_SUBSETS.items():
    register(_n, (lambda c: lambda: osql.long_features_sql(c))(_c))(_long_subset(_c))


@register("match_diffs", osql.match_diffs_sql)
def q_match_diffs(spark, sf_dir):
    from pitchline.operators.momentum import DIFF_PAIRS, match_features
    mf = match_features(matches(spark, sf_dir))
    return finish(mf.select("match_id", *[d for d, _ in DIFF_PAIRS]))


@register("elo_pre_chunked", osql.elo_sql)
def q_elo_pre_chunked(spark, sf_dir):
    """G1 through the chunked path (chunks of 1,000 matches per league), same
    result as ``elo_pre``."""
    from pitchline.operators.elo import elo_ratings
    return finish(elo_ratings(matches(spark, sf_dir), chunk_rows=1000))


@register("venue_history_segmented", osql.venue_history_sql)
def q_venue_history_segmented(spark, sf_dir):
    """W7 through the skew-safe path (segments of 97 rows, halo 5): same
    result as ``venue_history``."""
    from pitchline.operators.history import venue_history
    return finish(venue_history(matches(spark, sf_dir), seg_rows=97))


@register("match_features_segmented", osql.match_features_sql)
def q_match_features_segmented(spark, sf_dir):
    """Flagship through the skew-safe paths: team histories in segments of
    211 rows (halo 8 / 5, segmented exact EWM) and Elo in chunks of 1,000
    matches per league -- same result as ``match_features``."""
    from pitchline.operators.momentum import match_features
    return finish(match_features(matches(spark, sf_dir), seg_rows=211, chunk_rows=1000))


# ------------------------------------------------------------------ scans, drops, parameter grid
@register("scan_matches", lambda: osql.M.replace("m AS (", "", 1)[:-1])
def q_scan_matches(spark, sf_dir):
    """The match table as read (parquet scan + derivation)."""
    return finish(matches(spark, sf_dir))


@register("drop_columns", osql.drop_columns_sql)
def q_drop_columns(spark, sf_dir):
    """Drop the listed names that exist (missing names are ignored)."""
    from pitchline.sources.training import halftime_table
    t = halftime_table(spark, sf_dir)
    return finish(t.drop("referee", "stadium_name", "no_such_column").select(
        "match_id", "season", "status", "home_team_name", "away_team_name", "target_match_result"))


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """A parameter grid over walk-forward folds (Gaussian NB smoothing
    and logistic regression C, 3 folds)."""
    from pyspark.sql import functions as F
    from pitchline.operators.models import grid_search
    from pitchline.operators.prep import impute, imputation_values
    from pitchline.operators.splits import walk_forward
    x = _ht_stored(spark, sf_dir)
    folds = walk_forward(x, 3, [F.col("date_GMT").asc_nulls_last(), F.col("match_id").asc()])
    fill = imputation_values(folds.where(F.col("train_from_fold") == 0), HT_NUMERIC, "median")
    folds = impute(folds, HT_NUMERIC, fill, keep=["match_id", "target_match_result", "train_from_fold",
                                                   "val_fold"]).checkpoint(eager=True)
    a = grid_search(folds, HT_NUMERIC, "naive_bayes", {"var_smoothing": [1e-9, 1e-6]}, 3)
    b = grid_search(folds, HT_NUMERIC, "logistic_regression", {"C": [0.01, 1.0]}, 3)
    return a.unionByName(b)


@register("kickoff_epoch", osql.epoch_check_sql)
def q_kickoff_epoch(spark, sf_dir):
    """Epoch-seconds identifier column of the training table (zone-free)."""
    from pitchline.sources.training import halftime_table
    return halftime_table(spark, sf_dir).select("match_id", "timestamp")


@register("momentum_mismatches", osql.momentum_mismatches_sql)
def q_momentum_mismatches(spark, sf_dir):
    """E4 for the long table, every feature by a second route, with planted
    errors in a weighted mean, the EWM and the rest days."""
    from pyspark.sql import functions as F
    from pitchline.operators.elo import with_elo
    from pitchline.operators.long_table import long_table
    from pitchline.operators.momentum import KEYS, LONG_FEATURES, long_features
    from pitchline.operators.quality import feature_mismatches, momentum_recomputed, planted
    lt = long_table(with_elo(matches(spark, sf_dir)))
    actual = long_features(lt, keep=KEYS).where("team IS NOT NULL")
    for every, c in ((101, "form_pts_5"), (103, "odds_move_for_ewm_5"), (107, "rest_days")):
        actual = planted(actual, every, "match_id", c, F.col(c) + 1)
    return finish(feature_mismatches(actual, momentum_recomputed(lt), ["match_id", "is_home"], LONG_FEATURES))


def _odd_matches(spark, sf_dir, sides=("home_team", "away_team")):
    """The match table with missing leagues, and missing teams on ``sides``."""
    from pyspark.sql import functions as F
    m, k, none = matches(spark, sf_dir), F.col("match_id"), F.lit(None)
    return m.withColumns({"league_id": F.when(k % 10 == 0, none).otherwise(F.col("league_id")),
                          **{c: F.when(k % 53 == 0, none).otherwise(F.col(c)) for c in sides}})


@register("venue_history_null_teams", osql.venue_null_teams_sql)
def q_venue_history_null_teams(spark, sf_dir):
    """W7 in segments of 97 rows with matches that lack both teams."""
    from pitchline.operators.history import venue_history
    return finish(venue_history(_odd_matches(spark, sf_dir), seg_rows=97))


@register("elo_null_leagues", lambda: osql.with_odd_matches(osql.elo_sql(), "'None'", "away_team", "0"))
def q_elo_null_leagues(spark, sf_dir):
    """G1 in chunks of 1,000 with matches that lack a league or the home team
    (one team that plays in every league): ratings carry over between leagues
    and every match has a row."""
    from pitchline.operators.elo import elo_ratings
    return finish(elo_ratings(_odd_matches(spark, sf_dir, ("home_team",)), chunk_rows=1000))


def _register_more():
    from pitchline.plans import model_queries, sink_queries
    for name, sql, fn in (*model_queries.REGISTERED, *sink_queries.REGISTERED):
        register(name, sql)(fn)


_register_more()
