"""What the distributed model fits share: packed training rows, sums over tasks,
hash draws and the fitted model itself.

A fit reads one packed table (row id, class index, weight, feature array), written
once under the checkpoint folder.  The passes of a fit read its columns as Arrow
blocks that the executors keep, in memory and else on disk (``kept``): a pass plans no
query and decodes no file.  Every step of a fit adds up one fixed-length vector per
task (a gradient, a Hessian, histograms).  Their length depends on features, classes
and bins but never on rows; a bounded number of them comes to the driver, where there
are more tasks after another step of sums.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.operators.prep import q
from pitchline.session import remove_scratch, scratch_path

MAX_CLASSES = 100
PRIME = 2147483647
FEW_PARTS = 64                 # vectors of tasks that the driver adds up
BLOCK_ROWS = 50_000            # rows of a kept block
FEW_ROWS = 10_000_000          # packed rows up to which every core gets a file of them, whatever the partitions before
TASK_ROWS = 2000               # of a task at least


def draw(ids, stream: int):
    """A number in [0, 1) for every id, another one for every stream: fixed by
    both, whatever the order and the partitions of the rows."""
    h = np.asarray(ids, dtype=np.int64) % PRIME
    h = (h * 48271 + stream * 40014 + 12345) % PRIME
    h = ((h ^ (h >> 13)) * 69621) % PRIME
    h = ((h ^ (h >> 17)) * 39373) % PRIME
    return h / PRIME


def draw_column(id_: Column, stream: int) -> Column:
    """``draw`` of a column."""
    h = (F.pmod(id_.cast("long"), F.lit(PRIME).cast("long")) * 48271 + (stream * 40014 + 12345)) % PRIME
    h = h.bitwiseXOR(F.shiftright(h, 13)) * 69621 % PRIME
    h = h.bitwiseXOR(F.shiftright(h, 17)) * 39373 % PRIME
    return h / float(PRIME)


def draw_sql(id_sql: str, stream_sql: str) -> str:
    """DuckDB twin of ``draw``."""
    a = f"((CAST({id_sql} AS BIGINT) % {PRIME} + {PRIME}) % {PRIME} * 48271 + CAST({stream_sql} AS BIGINT) * 40014 + 12345) % {PRIME}"
    b = f"xor({a}, ({a}) >> 13) * 69621 % {PRIME}"
    c = f"xor({b}, ({b}) >> 17) * 39373 % {PRIME}"
    return f"(({c}) / {PRIME}e0)"


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of an Arrow column of arrays of one length, or of their bytes."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not len(column) or not width:
        return np.zeros((len(column), width), kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset]
    return np.frombuffer(data, kind, len(column) * width, int(at)).reshape(-1, width)


def row_bytes(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes: one copy each on the way from and to Spark,
    where an array takes one per element."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def as_block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def of_block(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def kept(rows: DataFrame) -> RDD:
    """``rows`` as Arrow blocks of about ``BLOCK_ROWS`` rows that the executors keep
    after the first pass; a lost one is read again from the files of ``rows``."""

    def pack(batches):
        held, n = [], 0

        def block():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([as_block(whole)], pa.binary())], names=["block"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return rows.mapInArrow(pack, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def task_sums(blocks: RDD | DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``fn`` over all ``kept`` blocks (or rows that are read once): a
    vector per task, of which ``FEW_PARTS`` at most come to the driver; more are added
    up before."""
    if isinstance(blocks, DataFrame):
        blocks = kept(blocks)
        try:
            return task_sums(blocks, fn, width)
        finally:
            blocks.unpersist()

    def run(blocks):
        total = np.zeros(width)
        for block in blocks:
            total += fn(of_block(block))
        yield total

    parts, n = blocks.mapPartitions(run), blocks.getNumPartitions()
    if n > FEW_PARTS:
        few = FEW_PARTS // 4
        parts = parts.zipWithUniqueId().map(lambda v: (v[1] % few, v[0])).reduceByKey(np.add, few).values()
    return sum(parts.collect(), np.zeros(width))


@dataclass
class Packed:
    """Packed training rows: (id long, y int, w double, x array<double>, xb binary);
    ``xb`` are the doubles of ``x`` as bytes, which the passes of a fit read."""
    rows: DataFrame
    path: str
    classes: list[str]
    features: list[str]
    n: int
    counts: list[int]
    center: list[float] | None = None
    scale: list[float] | None = None

    def close(self) -> None:
        remove_scratch(self.rows.sparkSession, self.path)


def vector(features: Sequence[str], center=None, scale=None) -> Column:
    """Features as an array; null is NaN, or the mean (0) where they are scaled."""
    x = [q(c).cast("double") for c in features]
    if center is None:
        return F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in x])
    return F.array(*[F.coalesce((c - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, m, s in zip(x, center, scale)])


def row_id(df: DataFrame, id_col: str | None, features: Sequence[str]) -> Column:
    if id_col in df.columns:
        return F.coalesce(F.col(id_col).try_cast("long"), F.xxhash64(*[q(c) for c in features]))
    return F.xxhash64(*[q(c) for c in features])


def pack(train: DataFrame, features: Sequence[str], label: str, scaled: bool, balanced: bool,
         id_col: str | None = "match_id", order: Sequence[str] = ()) -> Packed:
    """Pack the labelled rows of ``train``.  ``scaled``: features less their mean
    by their population deviation (1 for constants).  ``balanced``: weights
    n / (k n_c).  ``order``: further columns to keep, as ``o0``, ``o1``, ..."""
    t = train.where(q(label).isNotNull())
    counts = {str(r[0]): r[1] for r in t.groupBy(q(label)).count().limit(MAX_CLASSES + 1).collect()}
    if not counts:
        raise ValueError("no labelled training row")
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    classes, n = sorted(counts), sum(counts.values())
    center = scale = None
    if scaled:
        r = t.agg(*[f(q(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]).head()
        center, scale = [v or 0.0 for v in r[0::2]], [v or 1.0 for v in r[1::2]]
    weight = [n / (len(classes) * counts[c]) if balanced else 1.0 for c in classes]
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), q(label).cast("string")).cast("int") - 1
    p = len(features)
    as_bytes = F.arrow_udf(lambda x: row_bytes(matrix(x, p)), "binary")
    path = scratch_path(train.sparkSession, "packed")
    if n <= FEW_ROWS:
        t = t.repartition(min(train.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS + 1), row_id(t, id_col, features))
    t = t.select(row_id(t, id_col, features).alias("id"), y.alias("y"), vector(features, center, scale).alias("x"), *[q(c).alias(f"o{i}") for i, c in enumerate(order)])
    t.withColumns({"w": F.element_at(F.array(*[F.lit(v) for v in weight]), F.col("y") + 1), "xb": as_bytes("x")}).write.parquet(path)
    rows = train.sparkSession.read.parquet(path)
    return Packed(rows, path, classes, list(features), n, [counts[c] for c in classes], center, scale)


@dataclass
class Fitted:
    """A fitted classifier: plain numbers, savable as one JSON text."""
    kind: str
    features: list[str]
    classes: list[str]
    center: list[float] | None
    scale: list[float] | None
    state: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Fitted:
        return Fitted(**json.loads(text))

    def inputs(self) -> Column:
        return vector(self.features, self.center, self.scale)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
