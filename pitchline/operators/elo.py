"""Pre-match Elo ratings (G1).

Ratings start at 1500, carry across seasons, and are updated after every
match in kickoff order: expected home score
``E = 1 / (1 + 10**((away - (home + home_adv)) / 400))``, result score
1 / 0.5 / 0 (a match without goals counts as a home loss, as in the
reference), ``home += k*(S - E)``, ``away += k*((1-S) - (1-E))``.
``elo_diff_pre`` leaves the home advantage out.

Ratings belong to teams and carry over between leagues, so the fold is
sequential within a set of teams that meet each other, directly or through
others.  Where every team plays in one league only (one small aggregate tells)
the leagues are those sets, else the connected components of the teams are.
The sets are folded in parallel over the six narrow columns the fold needs;
the result is joined back on ``match_id``.

A set of more than ``CHUNK_ROWS`` matches (one count tells) is cut into chunks of
consecutive matches by exact positions from a range-partitioned sort.  As many
chunks as make ``STEP_ROWS`` matches of a set are one step: the steps are written
once under the checkpoint folder, all sets advance step by step, and the ratings
map (one row per team: bounded by the number of teams, not by matches) travels from
one step to the next as a small state table.  Inside a step the matches come in
order in Arrow batches and are folded piece by piece, so the Python process holds a
batch and the ratings, and the number of Spark jobs follows from the matches of the
largest set over ``STEP_ROWS``, however small the chunks.  Each step's output is
written, so a lost executor only repeats the current step.  Both forms return the
same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the rating model.
ELO_START = 1500.0
ELO_K = 20.0
ELO_HOME_ADV = 65.0

CHUNK_ROWS = 250_000           # matches of a set from which it is cut
STEP_ROWS = 2_000_000          # matches of a set that one step (a Spark job) folds: some 200 MB of a task's sort

ELO_COLUMNS = ["home_elo_pre", "away_elo_pre", "elo_diff_pre", "elo_home_win_prob_pre"]
_OUT_SCHEMA = ("match_id long, home_elo_pre double, away_elo_pre double, "
               "elo_diff_pre double, elo_home_win_prob_pre double")
_STEP_SCHEMA = f"g string, {_OUT_SCHEMA}, team string, rating double"


def _fold_rows(rows: pa.RecordBatch, ratings: dict, k: float, home_adv: float, skip_unplayed: bool) -> list[np.ndarray]:
    """The Elo columns of matches in order; ``ratings`` moves on."""
    goals = lambda c: rows.column(c).to_numpy(zero_copy_only=False).tolist()  # noqa: E731 - null is NaN
    he, ae, ex = [], [], []
    for home, away, hg, ag in zip(rows.column("home_team").to_pylist(), rows.column("away_team").to_pylist(), goals("home_goals"), goals("away_goals")):
        h, a = ratings.get(home, ELO_START), ratings.get(away, ELO_START)
        e = 1.0 / (1.0 + 10.0 ** ((a - (h + home_adv)) / 400.0))
        he.append(h)
        ae.append(a)
        ex.append(e)
        if skip_unplayed and (hg != hg or ag != ag):
            continue
        s = 1.0 if hg > ag else (0.5 if hg == ag else 0.0)
        ratings[home] = h + k * (s - e)
        ratings[away] = a + k * ((1.0 - s) - (1.0 - e))
    h, a = np.array(he), np.array(ae)
    return [h, a, h - a, np.array(ex)]


def _pieces(batch: pa.RecordBatch, keys) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal ``keys``."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for c in keys:
        v = batch.column(c)
        new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new).tolist()
    return (batch.slice(i, j - i) for i, j in zip(at, [*at[1:], batch.num_rows]))


def _fold(k: float, home_adv: float, skip_unplayed: bool):
    """Folds the sets of a partition sorted by set and order."""
    def run(batches):
        now, ratings = None, {}
        for batch in batches:
            for piece in _pieces(batch, ["g"]) if batch.num_rows else ():
                g = piece.column("g")[0].as_py()
                if g != now:
                    now, ratings = g, {}
                yield pa.RecordBatch.from_arrays([piece.column("match_id"), *map(pa.array, _fold_rows(piece, ratings, k, home_adv, skip_unplayed))],
                                                 names=["match_id", *ELO_COLUMNS])
    return run


def _step(k: float, home_adv: float, skip_unplayed: bool):
    """``_fold`` chunk by chunk, with the ratings before the step (chunk -1) and after it."""
    names = [c.split()[0] for c in _STEP_SCHEMA.split(", ")]

    def state(g, ratings):
        n = len(ratings)
        no = pa.nulls(n, pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([g] * n, pa.string()), pa.nulls(n, pa.int64()), no, no, no, no, pa.array(list(ratings), pa.string()),
                                           pa.array(list(ratings.values()), pa.float64())], names=names)

    def run(batches):
        now, ratings = None, {}
        for batch in batches:
            for piece in _pieces(batch, ["g", "_chunk"]) if batch.num_rows else ():
                g, n = piece.column("g")[0].as_py(), piece.num_rows
                if g != now:
                    if ratings:
                        yield state(now, ratings)
                    now, ratings = g, {}
                if piece.column("_chunk")[0].as_py() < 0:
                    ratings.update(zip(piece.column("home_team").to_pylist(), piece.column("rating").to_pylist()))
                    continue
                elo = map(pa.array, _fold_rows(piece, ratings, k, home_adv, skip_unplayed))
                yield pa.RecordBatch.from_arrays([piece.column("g"), piece.column("match_id"), *elo, pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())], names=names)
        if ratings:
            yield state(now, ratings)
    return run


def _chunked(narrow: DataFrame, counts: DataFrame, chunk_rows: int, k, home_adv, skip_unplayed) -> DataFrame:
    from pitchline.operators.splits import positional_index
    from pitchline.session import scratch_path
    spark = narrow.sparkSession
    order = [F.col("g"), F.col("kickoff").asc_nulls_last(), F.col("match_id").asc_nulls_last()]
    p = positional_index(narrow, order, "_pos")
    # a row per set that is cut: at most one per ``chunk_rows`` matches
    large = F.broadcast(counts.where(F.col("n") > chunk_rows).select("g"))
    start = p.join(large, "g", "left_semi").groupBy("g").agg(F.min("_pos").alias("_start"))
    p = p.join(F.broadcast(start), "g", "left")
    p = p.withColumn("_chunk", F.coalesce(F.floor((F.col("_pos") - F.col("_start")) / chunk_rows), F.lit(0)).cast("long"))
    p = p.withColumn("_step", F.floor(F.col("_chunk") / max(1, STEP_ROWS // chunk_rows)))
    src = scratch_path(spark, "elo-steps")
    columns = ["g", "_chunk", "_pos", "match_id", "home_team", "away_team", "home_goals", "away_goals"]
    p.select(*columns, "_step").write.partitionBy("_step").parquet(src)
    n_steps = spark.read.parquet(src).select(F.max("_step")).head()[0] + 1   # one small value
    out = scratch_path(spark, "elo-out")
    no = F.lit(None)
    for c in range(int(n_steps)):
        rows = spark.read.parquet(f"{src}/_step={c}").select(*columns, no.cast("double").alias("rating"))
        if c:
            before = spark.read.parquet(f"{out}/_step={c - 1}").where(F.col("team").isNotNull())
            rows = rows.union(before.select("g", F.lit(-1), F.lit(-1), no, "team", no, no, no, "rating"))
        res = rows.repartition("g").sortWithinPartitions("g", "_pos").mapInArrow(_step(k, home_adv, skip_unplayed), _STEP_SCHEMA)
        res.write.parquet(f"{out}/_step={c}")
    return spark.read.parquet(out).where(F.col("team").isNull()).select("match_id", *ELO_COLUMNS)


def _with_group(narrow: DataFrame, league_col: str) -> tuple[DataFrame, int]:
    """Add ``g``, the set of teams that a match belongs to: never NULL; and the
    number of matches."""
    home, away = F.col("home_team").cast("string"), F.col("away_team").cast("string")
    # a missing team is one team named "None", as in the fold
    narrow = narrow.withColumns({"home_team": F.coalesce(home, F.lit("None")), "away_team": F.coalesce(away, F.lit("None"))})
    sides = narrow.select(F.coalesce(F.col(league_col).cast("string"), F.lit("")).alias("league"),
                          F.explode(F.array("home_team", "away_team")).alias("team"))
    teams = sides.groupBy("team").agg(F.min("league").alias("a"), F.max("league").alias("b"), F.count(F.lit(1)).alias("n"))
    seen = teams.agg(F.count_if(F.col("a") != F.col("b")).alias("crossing"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    if not seen["crossing"]:
        return narrow.withColumn("g", F.coalesce(F.col(league_col).cast("string"), F.lit(""))), seen["n"] // 2
    from pitchline.operators.graph import components
    sets = components(narrow.select("home_team", "away_team").distinct(), "home_team", "away_team")
    return narrow.join(sets.select(F.col("node").alias("home_team"), F.col("label").alias("g")), "home_team"), seen["n"] // 2


def elo_ratings(m: DataFrame, k: float = ELO_K, home_adv: float = ELO_HOME_ADV,
                skip_unplayed: bool = False, league_col: str = "league_id",
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``match_id`` + the four pre-match Elo columns, one row per match (also
    without a league or a team).  Sets of more than ``chunk_rows`` matches are
    folded in chunks of so many."""
    narrow = m.select(league_col, "match_id", "kickoff", "home_team", "away_team",
                      F.col("home_goals").cast("double").alias("home_goals"),
                      F.col("away_goals").cast("double").alias("away_goals"))
    narrow, n = _with_group(narrow, league_col)
    narrow = narrow.drop(league_col)
    narrow = narrow.select("g", "match_id", "kickoff", "home_team", "away_team", "home_goals", "away_goals")
    counts = narrow.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # no set is larger than the table
    if n > chunk_rows and counts.agg(F.max("n")).head()[0] > chunk_rows:
        return _chunked(narrow, counts, chunk_rows, k, home_adv, skip_unplayed)
    order = [F.col("g"), F.col("kickoff").asc_nulls_last(), F.col("match_id").asc_nulls_last()]
    return narrow.repartition("g").sortWithinPartitions(*order).mapInArrow(_fold(k, home_adv, skip_unplayed), _OUT_SCHEMA)


def with_elo(m: DataFrame, **kw) -> DataFrame:
    return m.join(elo_ratings(m, **kw), "match_id", "left")
