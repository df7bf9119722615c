"""Every registered query with a SQL oracle agrees with DuckDB on sf0.001."""

from __future__ import annotations

import pytest

from check_oracle import compare
from pitchline.plans.registry import ORACLE, QUERIES

FAST = ["venue_history", "match_features", "elo_pre", "long_table", "match_flags", "parse_kickoff",
        "market_value", "season_range", "alias_map", "skeleton_with_value", "coverage", "page_links",
        "time_split", "walk_forward", "impute_median", "season_dist", "corr_groups", "corr_keep_drop",
        "class_metrics", "per_class_metrics", "best_model", "gaussian_nb", "range_checks",
        "feature_mismatches", "diff_checks", "duplicate_keys", "venue_history_segmented",
        "match_features_segmented", "elo_pre_chunked", "ewm_span5", "team_links", "squad_rows", "corr_with_gaps",
        "component_chain", "venue_history_null_teams", "elo_null_leagues", "momentum_mismatches", "impute_per_split",
        "corr_submatrix", "screening_report", "parse_ts_mixed", "coerce_numeric", "canonical_team", "sink_roundtrip", "report_roundtrip",
        "csv_encodings", "permutation_importance", "logistic_optimum", "boosted_first_round", "forest_roots", "model_failures", "feature_subset_modes",
        "skeleton_date_columns"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, sf_small, name):
    assert name in ORACLE
    res = compare(spark, sf_small, [name], verbose=False)
    assert res[name] == "OK", res[name]


# segments and chunks need more rows than the smallest tables have
CUT = ["momentum_mismatches", "venue_history_segmented", "match_features_segmented", "elo_pre_chunked", "venue_history_null_teams", "elo_null_leagues"]


@pytest.mark.parametrize("name", CUT)
def test_oracle_over_several_segments(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", [name], verbose=False)[name] == "OK"


def test_every_query_has_callable():
    assert len(QUERIES) >= 90
    assert set(ORACLE) <= set(QUERIES)
