"""Driver tables and the ``matches`` stand-in built on them.

The reference works on a wide match table (one row per match).  The test
tables are TPC-H-like, so ``matches`` derives a deterministic match table from
``orders`` x ``customer``: every derived value scales with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ratio(expr, div):
    return expr.cast("double") / F.lit(float(div))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match: ids, kickoff, league, season, teams, goals, result,
    strength and market columns.  Same definition as ``MATCHES_SQL``."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # customer is the dimension side of a fact-dimension join; the planner
    # broadcasts it only while its size stays under the broadcast threshold.
    b = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderdate").alias("kickoff"),
        F.col("c_nationkey").cast("bigint").alias("h"),
        ((F.col("c_nationkey") + 5 * (1 + F.col("o_orderkey") % 4)) % 25).cast("bigint").alias("a"),
        F.when(F.col("o_orderkey") % 97 == 0, None)
         .otherwise((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 5).alias("home_goals"),
        F.when(F.col("o_orderkey") % 97 == 0, None)
         .otherwise((F.col("o_orderkey") * 3 + F.col("c_nationkey")) % 4).cast("bigint").alias("away_goals"),
        (F.year("o_orderdate") - F.when(F.month("o_orderdate") < 7, 1).otherwise(0)).cast("bigint").alias("y"),
    )
    m = F.col("match_id")
    return b.select(
        m,
        "kickoff",
        (F.col("h") % 5).alias("league_id"),
        F.concat(F.col("y").cast("string"), F.lit("-"), (F.col("y") + 1).cast("string")).alias("season"),
        F.concat(F.lit("NATION_"), F.col("h").cast("string")).alias("home_team"),
        F.concat(F.lit("NATION_"), F.col("a").cast("string")).alias("away_team"),
        "home_goals",
        "away_goals",
        F.when(F.col("home_goals") > F.col("away_goals"), "H")
         .when(F.col("home_goals") == F.col("away_goals"), "D")
         .when(F.col("home_goals") < F.col("away_goals"), "A").alias("result"),
        _ratio(m % 31, 10).alias("home_ppg"),
        _ratio((m * 3) % 31, 10).alias("away_ppg"),
        _ratio(m % 29, 10).alias("home_xg"),
        _ratio((m * 5) % 29, 10).alias("away_xg"),
        F.when(m % 53 == 0, None).otherwise(_ratio(m % 41 - 20, 100)).alias("odds_move_home"),
        F.when(m % 59 == 0, None).otherwise(_ratio((m * 3) % 41 - 20, 100)).alias("odds_move_away"),
        _ratio(m % 37 - 18, 1000).alias("prob_shift_home"),
        _ratio(18 - m % 37, 1000).alias("prob_shift_away"),
        (F.abs(F.col("h") - F.col("a")).cast("double") * F.lit(37.5)).alias("travel_km"),
    )


# The same table for the DuckDB oracle (only raw tables are registered there).
MATCHES_SQL = """
WITH b AS (
  SELECT o_orderkey AS match_id, o_orderdate AS kickoff,
    CAST(c_nationkey AS BIGINT) AS h,
    (c_nationkey + 5 * (1 + o_orderkey % 4)) % 25 AS a,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_orderkey * 7 + o_custkey) % 5 END AS home_goals,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE (o_orderkey * 3 + c_nationkey) % 4 END AS away_goals,
    year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT match_id, kickoff, h % 5 AS league_id,
  concat(CAST(y AS STRING), '-', CAST(y + 1 AS STRING)) AS season,
  concat('NATION_', CAST(h AS STRING)) AS home_team,
  concat('NATION_', CAST(a AS STRING)) AS away_team,
  home_goals, away_goals,
  CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D'
       WHEN home_goals < away_goals THEN 'A' END AS result,
  CAST(match_id % 31 AS DOUBLE) / 10 AS home_ppg, CAST((match_id * 3) % 31 AS DOUBLE) / 10 AS away_ppg,
  CAST(match_id % 29 AS DOUBLE) / 10 AS home_xg, CAST((match_id * 5) % 29 AS DOUBLE) / 10 AS away_xg,
  CASE WHEN match_id % 53 = 0 THEN NULL ELSE CAST(match_id % 41 - 20 AS DOUBLE) / 100 END AS odds_move_home,
  CASE WHEN match_id % 59 = 0 THEN NULL ELSE CAST((match_id * 3) % 41 - 20 AS DOUBLE) / 100 END AS odds_move_away,
  CAST(match_id % 37 - 18 AS DOUBLE) / 1000 AS prob_shift_home,
  CAST(18 - match_id % 37 AS DOUBLE) / 1000 AS prob_shift_away,
  CAST(abs(h - a) AS DOUBLE) * 37.5E0 AS travel_km
FROM b
"""
