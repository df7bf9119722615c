"""Queries that write and read back: sinks with a manifest, reports, encodings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchline.plans.common import finish
from pitchline.plans.oracle_sql import M
from pitchline.sources.tables import matches

COLUMNS = ["match_id", "kickoff", "season", "home_team", "away_team", "home_goals", "away_goals", "home_xg", "league_id"]


def q_sink_roundtrip(spark, sf_dir):
    """Matches by league, sorted by kickoff, written with a manifest and
    checked against it; rows out of order inside a file are counted."""
    from pitchline.session import scratch_path
    from pitchline.sources.io import read_verified, write_verified
    path = scratch_path(spark, "sink")
    write_verified(matches(spark, sf_dir).select(*COLUMNS), path, partition_by=["league_id"], sort_by=["kickoff", "match_id"])
    back = read_verified(spark, path)
    before = F.lag(F.struct("kickoff", "match_id")).over(Window.partitionBy("file").orderBy("row"))
    rows = back.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.withColumn("late", F.coalesce(before > F.struct("kickoff", "match_id"), F.lit(False)))
    return finish(rows.groupBy("league_id").agg(
        F.count(F.lit(1)).alias("matches"), F.sum("match_id").alias("ids"), F.sum("home_goals").alias("goals"), F.sum("home_xg").alias("xg"),
        F.min("kickoff").cast("date").alias("first_day"), F.max("kickoff").cast("date").alias("last_day"),
        F.count_distinct("home_team").alias("teams"), F.count_if("late").alias("out_of_order")))


def sink_roundtrip_sql() -> str:
    from pitchline.plans.common import d10, r6
    return f"""WITH {M} SELECT league_id, count(*) AS matches, CAST(sum(match_id) AS BIGINT) AS ids, CAST(sum(home_goals) AS BIGINT) AS goals, {r6('sum(home_xg)', 'xg')},
  {d10('min(kickoff)', 'first_day')}, {d10('max(kickoff)', 'last_day')}, count(DISTINCT home_team) AS teams, CAST(0 AS BIGINT) AS out_of_order FROM m GROUP BY league_id"""


def q_report_roundtrip(spark, sf_dir):
    """A JSON report of the results per season, saved and loaded."""
    from pitchline.session import scratch_path
    from pitchline.sources.io import load_report, save_report
    seen = matches(spark, sf_dir).groupBy("season", "result").count().collect()      # seasons x results
    report = {"results": [{"season": r["season"], "result": r["result"], "n": r["count"]} for r in seen], "note": "Málaga – Köln"}
    back = load_report(spark, save_report(spark, report, scratch_path(spark, "report")))
    return finish(spark.createDataFrame([(r["season"], r["result"], r["n"], back["note"]) for r in back["results"]], "season string, result string, n long, note string"))


def report_roundtrip_sql() -> str:
    return f"WITH {M} SELECT season, result, count(*) AS n, 'Málaga – Köln' AS note FROM m GROUP BY season, result"


def q_csv_encodings(spark, sf_dir):
    """Accented names written in Latin-1 for odd leagues and in UTF-8 for even
    ones, read back from one folder, each file in its own encoding."""
    from pitchline.session import scratch_path
    from pitchline.sources.io import read_csv
    path = scratch_path(spark, "encodings")
    accented = F.translate("home_team", "AO", "ÁÖ")
    rows = matches(spark, sf_dir).select("match_id", accented.alias("home_team"), "league_id")
    for name, encoding, side in (("latin", "ISO-8859-1", 1), ("utf", "UTF-8", 0)):
        rows.where(F.col("league_id") % 2 == side).write.option("header", True).option("encoding", encoding).csv(f"{path}/{name}")
    return finish(read_csv(spark, f"{path}/*", "match_id long, home_team string, league_id long"))


def csv_encodings_sql() -> str:
    return f"WITH {M} SELECT match_id, replace(replace(home_team, 'A', 'Á'), 'O', 'Ö') AS home_team, CAST(league_id AS BIGINT) AS league_id FROM m"


REGISTERED = [
    ("sink_roundtrip", sink_roundtrip_sql, q_sink_roundtrip),
    ("report_roundtrip", report_roundtrip_sql, q_report_roundtrip),
    ("csv_encodings", csv_encodings_sql, q_csv_encodings),
]
