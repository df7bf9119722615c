"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``bits`` bits each, the cell of
every row gets its index on the Hilbert curve through the grid, the rows are
sorted by that index and the sorted run is cut into shards.  Rows close on the
curve are close in every dimension, so each shard covers a small box and its
min/max statistics prune on all dimensions at once.

Law ``rows``: row counts of the shards are at most one apart.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import col, shielded, stored, with_position, without

DIMS = (("lang", "text"), ("source", "text"), ("size", "log"), ("doc_id", "linear"))
BITS = 8
FINE = 4096             # steps of the histogram of a numeric dimension; a text one has 65536


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each column of ``axes`` (dimensions x rows),
    by Skilling's transposition (AIP Conf. Proc. 707, 2004)."""
    x = [a.astype(np.uint64) for a in axes]
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            hit = (x[i] & q) != 0
            t = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] >> np.uint64(b)) & one, t ^ ((one << np.uint64(b)) - one), t)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | (((x[i] ^ t) >> np.uint64(b)) & one)
    return out.astype(np.int64)


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.encode(), b.encode()):
        if x != y:
            break
        n += 1
    return n


def _fine_bins(df: DataFrame, dims: Sequence[tuple[str, str]]) -> list[Column]:
    """An order-preserving histogram step per dimension; 0 is null.  Steps of a
    linear dimension are equal widths between its extremes, of a ``log`` one
    equal ratios, of a text one the two bytes after the prefix that all values
    share.  One aggregate row reaches the driver."""
    span = df.agg(*[f(col(c)).alias(f"{k}{i}") for i, (c, _) in enumerate(dims) for k, f in (("a", F.min), ("b", F.max))]).head()
    bins = []
    for i, (c, kind) in enumerate(dims):
        lo, hi = span[f"a{i}"], span[f"b{i}"]
        if lo is None:
            b = F.lit(0)
        elif kind == "text":
            two = F.substring(F.encode(col(c), "UTF-8"), _common_prefix(lo, hi) + 1, 2)
            b = F.conv(F.rpad(F.hex(two), 4, "0"), 16, 10).cast("int") + 1
        elif kind == "log":
            b = F.floor(F.log2(F.greatest(col(c), F.lit(0)) + F.lit(1)) * F.lit(FINE / 64)) + 1
        else:
            b = F.floor((col(c).cast("double") - float(lo)) * (FINE / (float(hi) - float(lo) + 1))) + 1
        bins.append(F.coalesce(b.cast("int"), F.lit(0)))
    return bins


def with_hilbert(df: DataFrame, out: str, dims: Sequence[tuple[str, str]] = DIMS, bits: int = BITS,
                 stats: DataFrame | None = None) -> DataFrame:
    """``df`` with the Hilbert index of its quantised ``dims`` (column, kind) in
    ``out``.  Each dimension is cut at its own quantiles, read from a histogram
    of bounded size (``FINE`` or 65536 steps) of ``stats`` (default ``df``),
    so a skewed dimension still uses all of its ``bits``."""
    base = df if stats is None else stats
    bins = _fine_bins(base, dims)
    pairs = base.select(F.posexplode(F.array(*bins)).alias("dim", "bin"))
    rows = pairs.groupBy("dim", "bin").agg(F.count("*").alias("n")).collect()
    tables = []
    for i, (_, kind) in enumerate(dims):
        count = np.zeros((65536 if kind == "text" else FINE) + 2, dtype=np.int64)
        for r in rows:
            if r["dim"] == i:
                count[r["bin"]] = r["n"]
        before = np.cumsum(count) - count
        tables.append((before * (1 << bits) // max(1, int(count.sum()))).astype(np.int64))

    @F.pandas_udf("long")
    def index(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return pd.Series([], dtype="int64")
        a = np.stack(cells.to_numpy()).T
        return pd.Series(hilbert_index(np.stack([t[np.clip(x, 0, len(t) - 1)] for t, x in zip(tables, a)]), bits))

    return df.withColumn(out, index(F.array(*bins)))


OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")


@shielded()
def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 8; null: 8) and
    ``text_crc32`` (unsigned; a null text counts as empty)."""
    text = F.coalesce(col(text_col), F.lit(""))
    return without(docs, "size", "text_crc32").withColumns({
        "size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text.cast("binary"))})


@shielded("size", "text_crc32")
def hilbert_shards(rows: DataFrame, n_shards: int = 24, id_col: str = "doc_id",
                   dims: Sequence[tuple[str, str]] = DIMS, bits: int = BITS) -> DataFrame:
    """``measured`` rows with ``hilbert``, ``shard``, ``slot`` (gapless place in
    the shard), ``law`` = ``rows`` and ``grown_shard`` (null under this law).

    The order is (hilbert, text_crc32, id, size): equal texts of one cell are
    neighbours, rows tied on all four are interchangeable (the id is a dimension,
    so equal texts of far ids lie in different shards).  Null dimensions
    sort first.  Empty table: empty result.  Columns named like an output are
    replaced, all others are kept.
    """
    kept = [c for c in rows.columns if c.lower() not in OUT]
    d = without(rows, *(c for c in OUT if c not in ("size", "text_crc32")))
    stats = stored(d.select(*[col(c) for c, _ in dims]), "shard-dims")
    d = with_hilbert(d, "hilbert", dims, bits, stats)
    d, n = with_position(d, [F.col("hilbert"), F.col("text_crc32"), col(id_col), F.col("size")], "__pos", "shard-sorted")
    n = max(1, n)
    d = d.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int"),
                       "shard": F.expr(f"cast((__pos * {n_shards}L) div {n}L as int)")})
    # a shard begins at the least position p with p * n_shards div n = shard
    d = d.withColumn("slot", F.expr(f"__pos - ((shard * {n}L + {n_shards - 1}L) div {n_shards}L)"))
    return d.select(*[col(c) for c in kept], *OUT)


def op2_hilbert_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return hilbert_shards(stored(measured(docs).drop("text"), "shard-rows")).select("doc_id", *OUT)
