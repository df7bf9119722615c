"""Team-name keys and URL templating."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.functions.columns import col


@F.pandas_udf(T.StringType())
def _fold_accents_lower(s: pd.Series) -> pd.Series:
    # Spark has no NFKD normalisation: decompose, drop combining marks, lower.
    def one(v):
        if v is None:
            return None
        t = unicodedata.normalize("NFKD", v)
        return "".join(ch for ch in t if not unicodedata.combining(ch)).lower()
    return s.map(one)


def team_key_expr(c) -> Column:
    """X1 as a column expression (use ``with_team_key`` on large inputs)."""
    return F.regexp_replace(_fold_accents_lower(col(c).cast("string")), "[^a-zA-Z0-9]+", "")


def with_team_key(df: DataFrame, c: str, out: str = "team_key") -> DataFrame:
    """X1 over *distinct* names only, joined back: the Python step runs once
    per distinct spelling, not once per row."""
    names = df.select(F.col(c).alias("__name")).where(F.col("__name").isNotNull()).distinct()
    keys = names.select("__name", team_key_expr("__name").alias(out))
    return df.join(keys, df[c] == keys["__name"], "left").drop("__name")


# Path layouts of a squad page and a competition page (the host
# and the competition are parameters).
SQUAD_URL_PATH = "/%s/kader/verein/%s/saison_id/%d"
COMPETITION_URL_PATH = "/%s/startseite/wettbewerb/%s?saison_id=%d"


def squad_url(base, slug, team_id, season_id) -> Column:
    """URL templating with ``format_string``."""
    return F.format_string("%s" + SQUAD_URL_PATH, col(base), col(slug), col(team_id).cast("string"),
                           col(season_id).cast("int"))


def competition_url(base, slug, competition, season_id) -> Column:
    """X7 for the page that links a season's teams."""
    return F.format_string("%s" + COMPETITION_URL_PATH, col(base), col(slug), col(competition), col(season_id).cast("int"))
