"""Parsing and coercion (P1-P4, P20, P21, X4).  ANSI-safe: bad input -> NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.functions.columns import col

# Accepted layouts of a kickoff string, tried in order after the
# ISO forms.  A slashed date is month first where that is a date, else day first.
MIXED_TS_FORMATS = [
    "MMM d yyyy - h:mma",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
]
ISO_START = r"^\d{4}-\d{2}-\d{2}"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
KICKOFF_FORMAT = "MMM d yyyy - h:mma"        # e.g. 'Aug 18 2017 - 6:15pm'
SEASON_PATTERN = r"^(\d{4})-(\d{4})$"        # e.g. '2017-2018'
MONEY_SUFFIXES = [("bn", 1_000_000_000.0), ("m", 1_000_000.0), ("k", 1_000.0)]


def _iso(s: Column) -> Column:
    """ISO date or time with any fraction and zone (a zone is turned into the
    session's, UTC); NULL for other text."""
    return F.when(s.rlike(ISO_START), F.try_to_timestamp(s))


def parse_ts_mixed(c, formats=MIXED_TS_FORMATS) -> Column:
    """ISO in all its forms, else the first layout that parses, else NULL."""
    s = F.trim(col(c).cast("string"))
    return F.coalesce(_iso(s), *[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def parse_kickoff(c) -> Column:
    """Fixed layout ``MMM d yyyy - h:mma`` (am/pm in any case)."""
    return F.try_to_timestamp(F.trim(col(c)), F.lit(KICKOFF_FORMAT))


def parse_date_fallback(df: DataFrame, c: str, out: str = "match_date") -> DataFrame:
    """ISO parse; only if *no* value of the whole column parses, fall back
    to day-first.  The column-wide test is a scalar subquery (one tiny
    aggregate evaluated once), not a window over all rows."""
    iso = F.to_date(_iso(F.trim(col(c))))
    dayfirst = F.to_date(F.coalesce(F.try_to_timestamp(F.trim(col(c)), F.lit("d/M/yyyy")),
                                    F.try_to_timestamp(F.trim(col(c)), F.lit("d-M-yyyy"))))
    any_iso = df.select(F.coalesce(F.bool_or(iso.isNotNull()), F.lit(False))).scalar()
    return df.withColumn(out, F.when(any_iso, iso).otherwise(dayfirst))


def coerce_numeric(c) -> Column:
    """``to_numeric(errors='coerce')``."""
    return _number(F.trim(col(c).cast("string")))


def _number(s: Column) -> Column:
    """A cast alone would also take a type suffix, as in ``12d``."""
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def season_start_year(c) -> Column:
    """P20: 'YYYY-YYYY' with end = start + 1 -> start year, else NULL."""
    s = F.trim(col(c))
    a = F.regexp_extract(s, SEASON_PATTERN, 1)
    b = F.regexp_extract(s, SEASON_PATTERN, 2)
    ok = (a != "") & ((b).try_cast("int") == (a).try_cast("int") + 1)
    return F.when(ok, (a).try_cast("int"))


def season_start_year_strict(c) -> Column:
    """P20 strict form: raise on an invalid season instead of NULL."""
    y = season_start_year(c)
    return F.when(y.isNotNull(), y).otherwise(
        F.raise_error(F.concat(F.lit("Invalid season: "), F.coalesce(col(c), F.lit("NULL")))))


def season_label(year) -> Column:
    return F.concat(col(year).cast("string"), F.lit("-"), (col(year) + 1).cast("string"))


def season_range(start, end) -> Column:
    """The seasons from start to end inclusive, reversed bounds swapped."""
    a, b = season_start_year(start), season_start_year(end)
    return F.transform(F.sequence(F.least(a, b), F.greatest(a, b)), lambda y: season_label(y))


def with_market_value(df: DataFrame, c: str, out: str = "value_eur") -> DataFrame:
    """X4 as a DataFrame step (the cleaned string is named once, then split)."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.lower(F.trim(F.col(c).cast("string"))), " ", ""), ",", "."), "€", "")
    tmp = df.withColumn("__mv", s)
    x = F.col("__mv")
    bn, m, k = MONEY_SUFFIXES
    num = (F.when(x.endswith(bn[0]), F.expr("substring(__mv, 1, length(__mv) - 2)"))
            .when(x.endswith(m[0]), F.expr("substring(__mv, 1, length(__mv) - 1)"))
            .when(x.endswith(k[0]), F.expr("substring(__mv, 1, length(__mv) - 1)"))
            .otherwise(x))
    mult = (F.when(x.endswith(bn[0]), F.lit(bn[1])).when(x.endswith(m[0]), F.lit(m[1]))
             .when(x.endswith(k[0]), F.lit(k[1])).otherwise(F.lit(1.0)))
    val = F.when((x == "") | (x == "-") | x.isNull(), F.lit(None).cast("double")) \
           .otherwise(_number(num) * mult)
    return tmp.withColumn(out, val).drop("__mv")
