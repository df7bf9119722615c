"""Skew-safe ordered windows: split every key's history into segments.

A window ``partitionBy(key)`` puts a key's whole history in one task; if one
team held a third of all rows, one task would hold a third of the data.
Here each key's rows get their exact position (``positional_index`` on
(key, order): a range-partitioned sort, so a hot key is spread over many
tasks), are cut into segments of ``seg_rows`` positions, and the last
``halo`` rows of every segment are also copied into the next one.  Windows
then run on ``partitionBy(key, _seg).orderBy(_pos)``:

* look-back features of at most ``halo`` rows are exact on non-halo rows;
* cumulative features add, per segment, the totals of all earlier segments
  (``segment_offsets``: one row per segment, prefix-summed per key);
* halo rows are dropped at the end.

Work per task is bounded by ``seg_rows + halo`` whatever the key skew; the
copies cost ``halo / seg_rows`` extra rows.  ``rows_per_segment`` tells whether a
table needs segments; plain windows give the same rows, NULL keys included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.operators.long_table import order_by
from pitchline.operators.splits import positional_index

SEG_ROWS = 1_000_000         # matches of one team that a window task may hold


def rows_per_segment(m: DataFrame, limit: int = SEG_ROWS) -> int | None:
    """``limit`` if a team has more matches than that in the match table ``m``,
    else None.  Nothing is grouped where the whole table is no larger."""
    sides = m.select(F.explode(F.array("home_team", "away_team")).alias("team"))
    if m.count() <= limit or sides.groupBy("team").count().agg(F.max("count")).head()[0] <= limit:
        return None
    return limit



def segment(df: DataFrame, keys, seg_rows: int, halo: int, order: list[Column] | None = None) -> DataFrame:
    """Add ``_pos`` (0-based position within ``keys``), ``_seg`` and
    ``_halo`` (copy of an earlier segment's tail)."""
    if halo >= seg_rows:
        raise ValueError("halo must be smaller than the segment")
    order = order or order_by()
    p = positional_index(df, [*[F.col(k) for k in keys], *order], "_gpos")
    start = p.groupBy(*keys).agg(F.min("_gpos").alias("_start"))   # one row per key
    p = p.join(start, [p[k].eqNullSafe(start[k]) for k in keys]).drop(*[start[k] for k in keys])
    pos = F.col("_gpos") - F.col("_start")
    seg = F.floor(pos / F.lit(seg_rows))
    copies = F.when(pos % seg_rows >= seg_rows - halo,
                    F.array(F.struct(seg.alias("s"), F.lit(False).alias("h")),
                            F.struct((seg + 1).alias("s"), F.lit(True).alias("h")))) \
              .otherwise(F.array(F.struct(seg.alias("s"), F.lit(False).alias("h"))))
    out = p.select(*df.columns, pos.alias("_pos"), F.explode(copies).alias("_c"))
    return out.select(*df.columns, "_pos", F.col("_c.s").alias("_seg"), F.col("_c.h").alias("_halo"))


def segment_window(keys) -> Window:
    return Window.partitionBy(*keys, "_seg").orderBy("_pos")


def segment_offsets(seg_df: DataFrame, keys, sums: dict[str, Column]) -> DataFrame:
    """Per (keys, _seg): for each named sum, the total over all *earlier*
    segments of the key (non-halo rows only)."""
    tot = seg_df.where(~F.col("_halo")).groupBy(*keys, "_seg").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return tot.select(*keys, "_seg", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_off_{n}") for n in sums])
