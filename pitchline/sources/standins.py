"""Inputs the reference reads from CSV files or web pages, derived
deterministically from the driver tables (so their size grows with them).

* master matches: ``matches`` with the league named by its region;
* alias table: club spelling ``N<k> Club`` -> master team name (every 7th
  nation left out, so some team-seasons stay unresolved);
* team-seasons: the nations of each season in the skeleton, under one of
  three spellings (accented, club alias, lower case);
* player values: the suppliers of a nation, valued per season.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.sources.tables import matches, read_table


def master_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("league_id"),
                                                   F.col("r_name").alias("league"))
    return matches(spark, sf_dir).join(r, "league_id", "left")


def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.where(F.col("n_nationkey") % 7 != 3).select(
        F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("master_name"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(" Club")).alias("football_data_name"),
        F.col("n_nationkey").cast("long").alias("row_no"))


def team_seasons(spark: SparkSession, sf_dir: str, skeleton: DataFrame) -> DataFrame:
    """TeamSeason records: season, tm_season_id, team_id, slug, tm_team_name."""
    n = read_table(spark, sf_dir, "nation")
    st = skeleton.select("season", (F.substring("team_name", 8, 10)).try_cast("int").alias("nk")).distinct()
    return st.join(n, st.nk == n.n_nationkey).select(
        "season",
        (F.substring("season", 1, 4)).try_cast("int").alias("tm_season_id"),
        F.col("n_nationkey").cast("string").alias("team_id"),
        F.lower(F.col("n_name")).alias("slug"),
        _spelling().alias("tm_team_name"))


def _spelling():
    k = F.col("n_nationkey")
    return (F.when(k % 3 == 0, F.concat(F.lit("Natión "), k.cast("string")))
             .when(k % 3 == 1, F.concat(F.lit("N"), k.cast("string"), F.lit(" Club")))
             .otherwise(F.lower(F.col("n_name"))))


def player_values(spark: SparkSession, sf_dir: str, seasons: DataFrame) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("team_id"), F.col("s_name").alias("player_name"),
        F.col("s_acctbal").alias("acctbal"))
    return s.join(seasons.select("season", "tm_season_id", "team_id"), "team_id").select(
        "season", "tm_season_id", "team_id", "player_name",
        (F.col("acctbal") * 1000.0 + F.col("tm_season_id")).alias("player_market_value_eur"))


PAGE_SUPPLIERS = 40


def squad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squad pages (page_id, html) of the shapes real ones have: a name cell
    that holds a table, marked-up and encoded names, both kinds of quotes, rows
    of other classes, a table of another class before the right one.  A page
    holds the suppliers of a nation in one block of keys."""
    k = F.col("s_suppkey")
    name, key = F.col("s_name"), k.cast("string")
    link = F.when(k % 2 == 0, F.concat(F.lit("<a class=x href='/p/profil/spieler/"), key, F.lit("'>A &amp; <b>"), name, F.lit("</b></a>"))) \
            .otherwise(F.concat(F.lit('<a href="/p/profil/spieler/'), key, F.lit('">'), name, F.lit("</a>")))
    cell = F.when(k % 5 == 0, name).when(k % 3 == 0, F.concat(F.lit("<table class='inline'><tr><td></td><td>"), link, F.lit("</td></tr><tr class='sub'><td>Keeper</td></tr></table>"))).otherwise(link)
    value = F.when(k % 11 == 0, "-").otherwise(F.concat(F.lit("&euro;"), (k % 90 + 1).cast("string"), F.lit(".5"), F.when(k % 4 == 0, "k").otherwise("m")))
    cls = F.when(k % 7 == 0, "header").when(k % 2 == 0, "even bg").otherwise("odd")
    row = F.concat(F.lit("<tr class='"), cls, F.lit("'><td></td><td>"), cell, F.lit("</td><td class=\"r\">"), value, F.lit("</td></tr>"))
    s = read_table(spark, sf_dir, "supplier").withColumns({"row": row, "page_id": F.col("s_nationkey") * 10_000_000 + F.floor(k / PAGE_SUPPLIERS)})
    g = s.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "row"))).alias("rows"))     # a block's suppliers
    body = F.array_join(F.transform("rows", lambda r: r.getField("row")), "\n")
    return g.select(F.col("page_id").cast("long").alias("page_id"), F.concat(
        F.lit("<html><table class='other'><tbody><tr class='odd'><td>no</td><td>&euro;9m</td></tr></tbody></table><table class='items big'><thead><tr class='odd'><td>h</td></tr></thead><tbody>"),
        body, F.lit("</tbody></table><table class='items'><tbody><tr class='odd'><td>late</td><td>&euro;1m</td></tr></tbody></table></html>")).alias("html"))


def competition_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition pages (page_id, season_id, html): one per customer block, its
    customers as teams, some links of another season, with image links, marked
    up names and a second link of the same team."""
    k = F.col("c_custkey")
    season = F.when(k % 6 == 0, 2019).otherwise(2020).cast("string")
    path = F.concat(F.lit("/team-"), k.cast("string"), F.lit("/startseite/verein/"), k.cast("string"), F.lit("/saison_id/"), season)
    link = F.concat(F.lit("<a href='"), path, F.lit("'><img src=x></a><a title=\"t\" href=\""), path, F.lit("\"><span>Team</span> &amp; "), F.col("c_name"),
                    F.lit("</a><a href=\""), path, F.lit("\">again</a>"))
    c = read_table(spark, sf_dir, "customer").select(F.floor(k / 100).alias("page_id"), "c_custkey", link.alias("link"))
    g = c.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "link"))).alias("links"))     # 100 customers at most
    return g.select("page_id", F.lit(2020).alias("season_id"), F.array_join(F.transform("links", lambda r: r.getField("link")), " ").alias("html"))
