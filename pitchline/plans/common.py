"""Helpers shared by the registered queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.functions.columns import round6


def finish(df: DataFrame) -> DataFrame:
    """Normalise a query result for comparison: doubles rounded to 6 places,
    integral columns as BIGINT.  Pure projection: no rows are touched."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round6(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r6(expr: str, alias: str) -> str:
    """SQL twin of ``finish`` for one double column."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < 1e9 THEN sign({x}) * floor(abs({x}) * 1e6 + 0.5) / 1e6 "
            f"ELSE {x} END) + 0.0 AS {alias}")


def i64(expr: str, alias: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias}"


def d10(expr: str, alias: str) -> str:
    """SQL twin of ``finish`` for a DATE column (ISO text)."""
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d') AS {alias}"
