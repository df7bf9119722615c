"""Entity resolution and enrichment.

Input shape of the reference: a master match table, an optional alias table,
per-team-season squad pages.  Here pages arrive as a table and every step is a
DataFrame job: link extraction by regex over whole pages, team keys on
distinct names, m:1 joins guarded by a duplicate-key check, aggregations.
Small dimension sides (aliases, team-seasons) are left to the planner: AQE
broadcasts them only when their measured size is under the broadcast
threshold, otherwise they shuffle.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.functions.text import team_key_expr, with_team_key

# Built-in alias groups.  The first name of a group is the
# canonical spelling; every name of the group maps to it.
BUILTIN_TEAM_ALIAS_GROUPS = [
    ("athleticclubbilbao", "athbilbao", "athleticbilbao", "athleticclub"),
    ("atleticomadrid", "athmadrid", "atlmadrid", "atletico", "atleticodemadrid"),
    ("deportivoalaves", "alaves"),
    ("deportivolacoruna", "lacoruna", "deportivolacoruna"),
    ("rayovallecano", "vallecano", "rayo"),
    ("rcdespanyolbarcelona", "rcdespanyol", "espanyol", "espanol"),
    ("udlaspalmas", "laspalmas"),
    ("realvalladolid", "valladolid"),
    ("cadiz", "cadizcf"),
    ("malagacf", "malaga"),
    ("realbetisbalompie", "realbetis", "betis"),
    ("realsociedad", "sociedad"),
    ("fcbarcelona", "barcelona"),
    ("valenciacf", "valencia"),
    ("villarrealcf", "villarreal"),
    ("deportivoalaves", "deportivoalaves"),
]

# Fixed value: the path of a team link on a competition page.
TEAM_LINK_PATTERN = r"/([^/]+)/startseite/verein/(\d+)/saison_id/(\d+)"

# An anchor with its href in either kind of quotes; what it holds may be marked up.
ANCHOR_PATTERN = r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*')[^>]*>(.*?)</a\s*>"""
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

# Date columns of a master table, in order of preference.
SKELETON_DATE_COLUMNS = ["match_date", "match_datetime_utc", "kickoff_utc", "datetime_utc"]


class ManyToOneViolation(ValueError):
    pass


# ------------------------------------------------------------------ X2 / X3
def alias_columns(df: DataFrame) -> tuple[str, str]:
    """Pick (canonical, variant) columns: master_name / football_data_name,
    else canonical_name / variant_name (case-insensitive), else the first two."""
    low = {c.lower(): c for c in df.columns}
    for a, b in (("master_name", "football_data_name"), ("canonical_name", "variant_name")):
        if a in low and b in low:
            return low[a], low[b]
    return df.columns[0], df.columns[1]


def alias_map(spark: SparkSession, alias_rows: DataFrame | None = None,
              order_col: str | None = None) -> DataFrame:
    """(variant_key, canonical_key).  Built-in groups first; alias rows
    (canonical, variant; row order in ``order_col``) override them, the last
    row winning; empty keys are skipped; a row's canonical also maps to
    itself unless it is mapped already."""
    builtin = spark.createDataFrame(
        [(gi, ai, g[0], a) for gi, g in enumerate(BUILTIN_TEAM_ALIAS_GROUPS) for ai, a in enumerate(g)],
        "g int, a int, canonical string, variant string")
    # priority: built-ins in group order (later groups win), then table rows
    rows = builtin.select(
        team_key_expr("variant").alias("variant_key"), team_key_expr("canonical").alias("canonical_key"),
        F.lit(0).alias("src"), (F.col("g") * 1000 + F.col("a")).cast("long").alias("ord"))
    self_rows = builtin.select(team_key_expr("canonical").alias("variant_key"),
                               team_key_expr("canonical").alias("canonical_key"),
                               F.lit(-1).alias("src"), F.col("g").cast("long").alias("ord"))
    parts = [rows, self_rows]
    if alias_rows is not None:
        if order_col is None:
            raise ValueError("alias rows need order_col: the last row wins")
        cc, vc = alias_columns(alias_rows.drop(order_col))
        ar = alias_rows.where(F.col(cc).isNotNull() & F.col(vc).isNotNull()).select(
            team_key_expr(F.col(cc)).alias("c"), team_key_expr(F.col(vc)).alias("v"),
            F.col(order_col).cast("long").alias("ord"))
        ar = ar.where((F.col("c") != "") & (F.col("v") != "") & F.col("c").isNotNull() & F.col("v").isNotNull())
        parts.append(ar.select(F.col("v").alias("variant_key"), F.col("c").alias("canonical_key"),
                               F.lit(2).alias("src"), "ord"))
        parts.append(ar.select(F.col("c").alias("variant_key"), F.col("c").alias("canonical_key"),
                               F.lit(1).alias("src"), "ord"))
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    # src -1: setdefault(canonical) of built-ins (lowest), 0: built-in alias,
    # 1: setdefault(canonical) of a table row (only if unmapped so far),
    # 2: table alias (overrides).  setdefault never overrides, so a table
    # canonical beats only the built-in self rows when no alias exists.
    rank = (F.when(F.col("src") == 2, F.lit(3)).when(F.col("src") == 0, F.lit(2))
             .when(F.col("src") == -1, F.lit(1)).otherwise(F.lit(0))).cast("long")
    prio = rank * F.lit(1_000_000_000_000) + F.col("ord")
    return (allr.groupBy("variant_key")
                .agg(F.max_by("canonical_key", prio).alias("canonical_key")))


def canonical_key(df: DataFrame, c: str, amap: DataFrame, out: str = "team_key") -> DataFrame:
    """Single-hop lookup, default = own key (not transitive)."""
    keyed = with_team_key(df, c, "__k")
    j = keyed.join(amap, keyed["__k"] == amap["variant_key"], "left")
    return j.withColumn(out, F.coalesce(F.col("canonical_key"), F.col("__k"))) \
            .drop("__k", "variant_key", "canonical_key")


# ------------------------------------------------------------------ X5 / X6
def _plain(markup):
    """Text of a piece of HTML: no tags, entities decoded, single spaces."""
    text = F.regexp_replace(markup, "<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_links(pages: DataFrame, pattern: str = ANCHOR_PATTERN) -> DataFrame:
    """Every anchor of every page (whole HTML) with non-empty text; first
    occurrence per (page_id, href)."""
    anchors = F.regexp_extract_all(F.col("html"), F.lit(pattern), 0)
    one = pages.select("page_id", F.posexplode(anchors).alias("pos", "a"))
    href = F.regexp_extract("a", pattern, 1)
    one = one.select("page_id", "pos", href.substr(F.lit(2), F.length(href) - 2).alias("href"),
                     _plain(F.regexp_extract("a", pattern, 2)).alias("link_text")).where(F.col("link_text") != "")
    return (one.groupBy("page_id", "href")
              .agg(F.min_by(F.struct("pos", "link_text"), "pos").alias("f"))
              .select("page_id", "href", F.col("f.pos").alias("pos"), F.col("f.link_text").alias("link_text")))


def team_links(pages: DataFrame, season_id_col: str = "season_id") -> DataFrame:
    """X5 with the team-link pattern: (season_id, team_id, slug, team_name),
    only links whose season equals the page's season, first per team."""
    links = page_links(pages.select("page_id", "html"))
    m = links.select(
        "page_id", "pos", "link_text",
        F.regexp_extract("href", TEAM_LINK_PATTERN, 1).alias("slug"),
        F.regexp_extract("href", TEAM_LINK_PATTERN, 2).alias("team_id"),
        (F.regexp_extract("href", TEAM_LINK_PATTERN, 3)).try_cast("int").alias("href_season"))
    m = m.join(pages.select("page_id", season_id_col), "page_id")
    m = m.where((F.col("slug") != "") & (F.col("href_season") == F.col(season_id_col)))
    return (m.groupBy(season_id_col, "team_id")
              .agg(F.min_by(F.struct("slug", "link_text"), F.struct("page_id", "pos")).alias("f"))
              .select(season_id_col, "team_id", "f.slug", F.col("f.link_text").alias("tm_team_name")))


class _SquadTable(HTMLParser):
    """Rows of class odd / even in the body of the first ``table.items``: the
    player link's text and the text of every cell, nested ones included."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.tables = self.body = 0         # depth of tables inside the items table; depth of its tbody
        self.done = False
        self.trs: list[dict | None] = []    # open rows, None for those of another class
        self.cells: list[list[str]] = []
        self.link: list[str] | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        have = {k: v or "" for k, v in attrs}
        classes = have.get("class", "").split()
        if tag == "table" and (self.tables or "items" in classes):
            self.tables += 1
        elif not self.tables:
            return
        elif tag == "tbody":
            self.body += 1
        elif tag == "tr":
            row = {"link": "", "cells": []} if self.body and {"odd", "even"} & set(classes) else None
            self.trs.append(row)
            if row is not None:
                self.rows.append(row)
        elif tag == "td":
            self.cells.append([])
            for row in self.trs:
                if row is not None:
                    row["cells"].append(self.cells[-1])
        elif tag == "a" and "/profil/spieler/" in have.get("href", ""):
            self.link = []

    def handle_endtag(self, tag):
        if not self.tables or self.done:
            return
        if tag == "table":
            self.tables -= 1
            self.done = not self.tables
        elif tag == "tbody":
            self.body -= 1
        elif tag == "tr" and self.trs:
            self.trs.pop()
        elif tag == "td" and self.cells:
            self.cells.pop()
        elif tag == "a" and self.link is not None:
            text, self.link = " ".join(self.link), None
            for row in self.trs:
                if row is not None and not row["link"]:
                    row["link"] = text

    def handle_data(self, data):
        if self.tables and not self.done and (text := " ".join(data.split())):
            for cell in self.cells:
                cell.append(text)
            if self.link is not None:
                self.link.append(text)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("row_pos", T.IntegerType()), T.StructField("player_name", T.StringType()),
                                        T.StructField("value_raw", T.StringType())])))
def _squad_table(html: pd.Series) -> pd.Series:
    def one(page):
        out = []
        for i, row in enumerate(_SquadTable(page or "").rows):
            cells = [" ".join(c) for c in row["cells"]]
            if cells:
                out.append({"row_pos": i, "player_name": row["link"] or next((c for c in cells if c), ""), "value_raw": cells[-1]})
        return out
    return html.map(one)


def squad_rows(pages: DataFrame) -> DataFrame:
    """Player rows of squad pages (page_id, html): rows of class odd / even
    of ``table.items``; the player name is the profile link's text, else the
    first non-empty cell; the value is the last cell; rows without name or
    value are dropped."""
    from pitchline.functions.parse import with_market_value
    r = pages.select("page_id", F.explode(_squad_table("html")).alias("r")).select("page_id", "r.*")
    r = with_market_value(r, "value_raw", "player_market_value_eur")
    return r.where((F.col("player_name") != "") & F.col("player_market_value_eur").isNotNull()).drop("value_raw")


# ------------------------------------------------------------------ U2
def team_match_skeleton(master: DataFrame, league: str | None = None,
                        league_label: str | None = None) -> DataFrame:
    """One row per (league, season, match_date, team_name)."""
    missing = {"season", "home_team", "away_team"} - set(master.columns)
    if missing:
        raise ValueError(f"master table lacks {sorted(missing)}")
    date_col = next((c for c in SKELETON_DATE_COLUMNS + ["kickoff"] if c in master.columns), None)
    if date_col is None:
        raise ValueError(f"master table needs one of {SKELETON_DATE_COLUMNS}")
    df = master
    if league is not None and "league" in df.columns:  # P12
        df = df.where(F.lower(F.col("league").cast("string")) == league.lower())
    if isinstance(df.schema[date_col].dataType, T.StringType):   # P3: ISO, else day-first for the column
        from pitchline.functions.parse import parse_date_fallback
        df = parse_date_fallback(df, date_col, "__md")
    else:
        df = df.withColumn("__md", F.to_date(F.col(date_col)))
    df = df.select("season", F.col("__md").alias("match_date"), "home_team", "away_team") \
           .where(F.col("match_date").isNotNull())   # P13
    teams = F.explode(F.array(F.col("home_team"), F.col("away_team"))).alias("team_name")
    out = df.select("season", "match_date", teams).dropDuplicates()
    return out.select(F.lit(league_label or league).alias("league"), "season", "match_date", "team_name")


# ------------------------------------------------------------------ J5
def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once (the right side of an m:1 join)."""
    return df.groupBy(*keys).count().where(F.col("count") > 1).withColumnRenamed("count", "n")


def assert_many_to_one(right: DataFrame, keys, what: str = "right side") -> None:
    """J5 guard: one tiny job (``limit(1)`` on the grouped keys)."""
    dup = duplicate_keys(right, keys).limit(1).collect()
    if dup:
        raise ManyToOneViolation(f"{what} has duplicate keys {keys}: {dup[0].asDict()}")


# ------------------------------------------------------------------ J2 / J4
def resolve_teams(skeleton: DataFrame, team_meta: DataFrame, amap: DataFrame,
                  check: bool = True) -> DataFrame:
    """Team-season rows get the master team name through canonical keys
    on (season, team_key), m:1 enforced; resolved = master name, else own."""
    master = canonical_key(skeleton.select("season", "team_name").distinct(), "team_name", amap)
    meta = canonical_key(team_meta, "tm_team_name", amap)
    if check:
        assert_many_to_one(master, ["season", "team_key"], "master names")
    j = meta.join(master, ["season", "team_key"], "left")
    return j.withColumn("resolved_team_name", F.coalesce(F.col("team_name"), F.col("tm_team_name")))


def unresolved_teams(resolved: DataFrame) -> DataFrame:
    """Team-season rows without a master name."""
    return resolved.where(F.col("team_name").isNull())


# ------------------------------------------------------------------ A1 / J3 / A7
def squad_values(team_seasons: DataFrame, players: DataFrame,
                 keys=("season", "team_id")) -> DataFrame:
    """A1: per team-season, sum and count of player values; the sum is NULL
    for a team without valued players, the count 0.  Players are
    pre-aggregated by key before the join (map-side combine)."""
    agg = players.groupBy(*keys).agg(F.sum("player_market_value_eur").alias("squad_market_value_sum"),
                                     F.count("player_market_value_eur").alias("player_count_with_value"))
    j = team_seasons.join(agg, list(keys), "left")
    return j.withColumn("player_count_with_value", F.coalesce(F.col("player_count_with_value"), F.lit(0)))


def skeleton_with_value(skeleton: DataFrame, squad: DataFrame, check: bool = True) -> DataFrame:
    """Skeleton left-join team-season values on (season, team_name), m:1."""
    right = squad.select("season", "team_name", "squad_market_value_sum", "team_id")
    if check:
        assert_many_to_one(right, ["season", "team_name"], "team-season values")
    return skeleton.join(right, ["season", "team_name"], "left")


def coverage_report(master: DataFrame, skeleton: DataFrame, team_meta: DataFrame,
                    squad: DataFrame, players: DataFrame, unresolved: DataFrame,
                    merged: DataFrame) -> DataFrame:
    """One-row report.  Every figure is a scalar subquery over its own
    input (each a small aggregate job); no row data reaches the driver."""
    def n(df):
        return df.select(F.count(F.lit(1))).scalar()
    spark = master.sparkSession
    miss = merged.select(F.count_if(F.col("squad_market_value_sum").isNull())).scalar()
    ratio = merged.select(F.coalesce(F.avg(F.col("squad_market_value_sum").isNotNull().cast("double")),
                                     F.lit(0.0))).scalar()
    return spark.range(1).select(
        n(master).alias("master_rows"), n(skeleton).alias("skeleton_rows"),
        n(team_meta).alias("team_seasons_discovered"), n(squad).alias("unique_team_season_rows"),
        n(players).alias("player_value_rows"), n(unresolved).alias("unresolved_team_name_mappings"),
        miss.alias("skeleton_rows_missing_squad_value"), ratio.alias("coverage_ratio"))
