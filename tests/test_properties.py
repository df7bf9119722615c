"""Randomised checks of the window kernels against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchline.functions.columns import lag_columns, newer_count_columns, weighted_from_lags
from pitchline.operators.ewm import with_prior_ewm


def _py_wavg(prev, k):
    v = [x for x in prev[-k:] if x is not None]
    if not v:
        return None
    w = list(range(k - len(v) + 1, k + 1))
    return sum(a * b for a, b in zip(v, w)) / sum(w)


def _py_ewm(prev, span=5):
    alpha = 2.0 / (span + 1)
    y, w = None, 1.0
    for x in prev:
        if y is None:
            if x is not None:
                y, w = x, 1.0
            continue
        w *= 1 - alpha
        if x is not None:
            y = (w * y + alpha * x) / (w + alpha)
            w = 1.0
    return y


def test_random_sequences(spark):
    rng = random.Random(7)
    rows = []
    for t in range(6):
        n = rng.randint(1, 60)
        for i in range(n):
            x = None if rng.random() < 0.3 else round(rng.uniform(-5, 5), 3)
            rows.append((f"T{t}", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), i + 1000 * t, x))
    df = spark.createDataFrame(rows, "team string, kickoff timestamp_ntz, match_id long, x double").repartition(3, "team")
    w = Window.partitionBy("team").orderBy("kickoff", "match_id")
    specs = [("x", 3), ("x", 5), ("x", 8)]
    got = df.select("*", *lag_columns(specs, w)).select("*", *newer_count_columns(specs)) \
        .select("team", "match_id", *[weighted_from_lags("x", k).alias(f"w{k}") for _, k in specs])
    ew = with_prior_ewm(df.repartition("team").sortWithinPartitions("team", "kickoff", "match_id"), [("x", "e")])
    res = got.join(ew.select("match_id", "e"), "match_id").toPandas().set_index("match_id")
    by_team = {}
    for team, ko, mid, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        prev = by_team.setdefault(team, [])
        for k in (3, 5, 8):
            exp = _py_wavg(prev, k)
            got_v = res.loc[mid, f"w{k}"]
            assert (exp is None and pd.isna(got_v)) or math.isclose(got_v, exp, rel_tol=1e-12, abs_tol=1e-12)
        exp = _py_ewm(prev)
        got_e = res.loc[mid, "e"]
        assert (exp is None and pd.isna(got_e)) or math.isclose(got_e, exp, rel_tol=1e-12, abs_tol=1e-12)
        prev.append(x)
