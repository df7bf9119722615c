"""Long -> wide (J1 / U5): attach home-side and away-side features back to
their match with ``home_`` / ``away_`` prefixes.

Each match has exactly two long rows, so one hash aggregation by match_id
(bounded groups, no skew) replaces the reference's two left merges.  A side
whose team is NULL has no history and gets NULL features, as in the left
merge of the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_columns(features):
    aggs = []
    for side, v in (("home", 1), ("away", 0)):
        keep = (F.col("is_home") == v) & F.col("team").isNotNull()
        for c in features:
            aggs.append(F.max(F.when(keep, F.col(c))).alias(f"{side}_{c}"))
    return aggs


def to_match_rows(lf: DataFrame, features) -> DataFrame:
    return lf.groupBy("match_id").agg(*side_columns(features))
