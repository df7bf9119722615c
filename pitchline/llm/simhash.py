"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last one
padded with zeros).  Every 23-bit word lies within distance 3 of exactly one
codeword of the binary Golay code; a word at distance 3 also has five codewords
at distance 4.  These one or six codewords are the segment's keys, and two
words at distance 2 or less always share a key (checked exhaustively in the
tests).  Of two fingerprints at distance 4 or less, the two segments with the
fewest differing bits differ by 2 bits or less in all, so for one of the three
pairs of segments both segments share a key: joining on (pair of segments, key,
key) finds every link, and the distance of each candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pitchline.llm.common import col, lookup_join, shielded, stored, without
from pitchline.llm.components import components

GOLAY_POLY = 0xC75             # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_BITS = 4                   # the most differing bits that the keys cover
SHINGLE = 4
BLOCK_ROWS = 4096              # members of a key compared in one task
SAMPLED = 16                   # one fingerprint in so many is counted to find large keys


def _bit_table() -> np.ndarray:
    return ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: XXH64 (seed 42) of every word shingle, a bit is 1
    if set in over half of them; 0 without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else ()    # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        table = _bit_table()
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ table for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, out: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return without(docs, out).withColumn(out, simhash(col(text_col).cast("string")))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight 3 or less; whether it has weight
    3; the five patterns of weight 4 (zeros where there are none)."""
    lead, deep, four = np.zeros(2048, np.int64), np.zeros(2048, bool), np.zeros((2048, 5), np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << i for i in bits)
            s = int(_syndrome(np.array([e]))[0])
            lead[s], deep[s] = e, weight == 3
    patterns = np.array([sum(1 << i for i in bits) for bits in combinations(range(23), 4)])
    syndromes = _syndrome(patterns)
    order = np.argsort(syndromes, kind="stable")
    for s in np.flatnonzero(deep):
        at = np.searchsorted(syndromes[order], s)
        four[s] = patterns[order[at:at + 5]]
    return lead, deep, four


def _syndrome(words: np.ndarray) -> np.ndarray:
    v = words.astype(np.int64)
    for b in range(22, 10, -1):
        v = np.where(v >> b & 1, v ^ (GOLAY_POLY << (b - 11)), v)
    return v


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (12 bits) of 23-bit words, six columns, and which count."""
    lead, deep, four = _golay()
    s = _syndrome(words)
    keys = np.concatenate([(words ^ lead[s])[:, None], words[:, None] ^ four[s]], axis=1) >> 11
    valid = np.repeat(deep[s][:, None], 6, axis=1)
    valid[:, 0] = True
    return keys, valid


def pair_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fps``, key): for each pair of segments every combination of
    their codeword indices, the pair's number in the bits above."""
    u = fps.view(np.uint64)
    seg = [segment_keys(((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    rows, keys = [], []
    for no, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        both = seg[i][1][:, :, None] & seg[j][1][:, None, :]
        key = (no << 24) | (seg[i][0][:, :, None] << 12) | seg[j][0][:, None, :]
        rows.append(np.nonzero(both)[0])
        keys.append(key[both])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(fps: DataFrame, large: dict[int, int]) -> DataFrame:
    """(key, part, fp): a key of a large group goes to every pair of its blocks."""
    schema = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("fp", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.array(sorted(large), dtype=np.int64)
        blocks = np.array([large[k] for k in many], dtype=np.int64)
        for batch in batches:
            every = batch.column("fp").to_numpy()
            for at in range(0, len(every), 2048):
                fp = every[at:at + 2048]
                row, key = pair_keys(fp)
                fp, part = fp[row], np.zeros(len(key), dtype=np.int64)
                if len(many):
                    at_many = np.minimum(np.searchsorted(many, key), len(many) - 1)
                    n = np.where(many[at_many] == key, blocks[at_many], 1)
                    mine = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                    copy = np.repeat(np.arange(len(key)), n)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
                    part = np.minimum(mine[copy], other) * (1 << 20) + np.maximum(mine[copy], other)
                    key, fp = key[copy], fp[copy]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(fp)], schema=schema)

    return fps.mapInArrow(emit, "key long, part long, fp long")


def linked(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (least member, member) that span the clusters of one group of
    different fingerprints linked at ``max_bits`` or less."""
    left = np.sort(fps)
    while len(left) > 1:
        root, queue, left, found = left[0], [left[0]], left[1:], []
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= max_bits
            if near.any():
                found.append(left[near])
                queue.extend(found[-1])
                left = left[~near]
        if found:
            b = np.concatenate(found)
            yield np.full(len(b), root), b


def _edges(keys: DataFrame, max_bits: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by (key, part); groups of one key are compared inside."""
        held: list[np.ndarray] = []

        def groups(cut: np.ndarray, fp: np.ndarray):
            edge = np.flatnonzero(cut)
            size = np.diff(np.append(edge, len(fp)))
            pairs = edge[size == 2]
            near = np.bitwise_count((fp[pairs] ^ fp[pairs + 1]).view(np.uint64)) <= max_bits
            a, b = [np.minimum(fp[pairs], fp[pairs + 1])[near]], [np.maximum(fp[pairs], fp[pairs + 1])[near]]
            for at, n in zip(edge[size > 2], size[size > 2]):
                for x, y in linked(np.unique(fp[at:at + n]), max_bits):
                    a.append(x)
                    b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            held.append(rows)
            last = rows[-1, :2] if len(rows) else None
            if last is None or (rows[0, :2] == last).all():
                continue                                  # the batch holds one group, which may go on
            rows = np.concatenate(held)
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            end = np.flatnonzero(new)[-1]                 # the last group may go on in the next batch
            held = [rows[end:]]
            yield groups(new[:end], np.ascontiguousarray(rows[:end, 2]))
        if held:
            rows = np.concatenate(held)
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            yield groups(new, np.ascontiguousarray(rows[:, 2]))

    by_key = keys.repartition("key", "part").sortWithinPartitions("key", "part")
    return by_key.mapInArrow(verify, "a long, b long").distinct()


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, root) of the different fingerprints (column ``fp``) that have a
    link.  A key with more than ``block_rows`` members (estimated from a sample
    of the fingerprints) is cut into blocks by hash and every two blocks meet
    in a task of their own, so no task holds a large group; the links are the
    same whether or not a key is cut."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys cover {MAX_BITS} differing bits")
    part = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)
    counts = _key_rows(part, {}).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > block_rows)
    # each large key stands for block_rows / SAMPLED sampled rows at least
    large = {r["key"]: -(-r["n"] * SAMPLED // block_rows) for r in counts.collect()}
    return components(_edges(_key_rows(fps, large), max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, text_hash, fp, component_id, stays) per row of ``docs``:
    component_id is the least id reachable over links of ``max_bits`` or fewer
    differing bits, ``stays`` marks the rows of the least (id, text) of each
    component.

    Null and wordless texts have fingerprint 0 and link like any other.  Equal
    fingerprints meet in a partial aggregate, so copies of one text cost one
    row per task.  A null id is the least only in a component without another.
    Repeated rows are all returned.  Empty table: empty result.
    """
    rows = with_fingerprint(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "fp", "text", shingle)
    rows = stored(rows.select("id", F.xxhash64("text").alias("text_hash"), "fp"), "simhash-rows")
    rank = F.struct(F.col("id").isNull().alias("null"), F.col("id"), F.col("text_hash"))
    classes = stored(rows.groupBy("fp").agg(F.min(rank).alias("least")), "simhash-classes")
    comp = stored(fingerprint_components(classes.select("fp"), max_bits), "simhash-components")
    member = comp.join(classes, F.col("node") == F.col("fp")).select("root", "least")
    lows = member.groupBy("root").agg(F.min("least").alias("low"))
    low = comp.join(lows, "root").select(F.col("node").alias("fp"), "low")
    # written, so that the join below reads two plain exchanges and a fingerprint
    # shared by a third of all rows is split
    final = stored(classes.join(low, "fp", "left").select("fp", F.coalesce("low", "least").alias("low")), "simhash-final")
    return rows.join(final, "fp").select(
        F.col("id").alias(id_col), "text_hash", "fp", F.col("low.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("low.id")) & (F.col("text_hash") == F.col("low.text_hash"))).alias("stays"))


@shielded()
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the least id."""
    names = docs.columns
    found = stored(near_duplicates(docs, id_col, text_col, shingle, max_bits).select(col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), "stays"), "simhash-found")
    gone = found.where(~F.col("stays")).select("__id", "__hash").distinct()
    d = docs.withColumns({"__id": col(id_col), "__hash": F.xxhash64(col(text_col))})
    d = lookup_join(d, gone, ["__id", "__hash"], "left_anti")
    # the same row several times: found only by counting, rarely there at all
    again = found.where("stays").groupBy("__id", "__hash").agg(F.count("*").alias("n")).where("n > 1").select("__id", "__hash")
    again = stored(again, "simhash-again")
    if not again.isEmpty():
        single = lookup_join(d, again, ["__id", "__hash"], "left_anti")
        d = single.union(lookup_join(d, again, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]))
    return d.select(*[col(c) for c in names])


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash_golay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
