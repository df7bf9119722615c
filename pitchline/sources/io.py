"""Sources and sinks (S1-S6): CSV scan with an encoding fallback, guards of paths
and columns, table sinks with a manifest, report sinks and their round trips."""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    pass


class CorruptTable(ValueError):
    pass


class InputNotFound(AnalysisException, FileNotFoundError):
    """Raised before any job: the error that Spark itself would raise later."""

    def __init__(self, path: str):
        AnalysisException.__init__(self, message=f"input path not found: {path}")

    def __str__(self) -> str:
        return self._message


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def ensure_path(spark: SparkSession, path: str) -> str:
    """Raise before any job when nothing is at ``path`` (patterns allowed)."""
    where, fs = _file_system(spark, path)
    if not fs.globStatus(where):
        raise InputNotFound(path)
    return path


def ensure_columns(df: DataFrame, required, name: str = "DataFrame") -> DataFrame:
    """S3: raise before any action when required columns are absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"{name} lacks required columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             encodings=("UTF-8", "ISO-8859-1")) -> DataFrame:
    """S1 + S2: header CSV files, each in its own encoding: a file with a line
    that is not valid in the first one (UTF-8) is read in the second, which
    accepts every byte, so the reference's later fallbacks can never be
    reached.  Only the names of such files come to the driver."""
    ensure_path(spark, path)
    def load(paths, enc):
        r = spark.read.option("header", True).option("encoding", enc).option("mode", "PERMISSIVE")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(paths)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    good = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).collect()     # one row per file
    if all(r["ok"] for r in good) or len(encodings) < 2:
        return load(path, encodings[0])
    parts = [load(files, enc) for enc, ok in zip(encodings, (True, False)) if (files := [r["file"] for r in good if r["ok"] == ok])]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None, sort_by=None) -> str:
    """Table sink (parquet by default; csv with a header); ``sort_by``:
    the written files follow the total order of these columns, within each
    partition where there are ``partition_by`` columns (the writer sorts by those
    first and keeps no other order unless it is part of the same sort)."""
    if sort_by:
        keys = [*(partition_by or []), *sort_by]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def save_report(spark: SparkSession, report: dict, path: str) -> str:
    """A report / training log as one JSON row, stamped with the time."""
    row = dict(report)
    row["timestamp"] = _dt.datetime.now().isoformat()
    spark.createDataFrame([(json.dumps(row, ensure_ascii=False, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)
    return path


def load_report(spark: SparkSession, path: str) -> dict:
    """S6 read side: the single JSON row back as a dict."""
    rows = spark.read.text(path).limit(1).collect()
    return json.loads(rows[0].value) if rows else {}


# ------------------------------------------------------------------ tables with a manifest
def file_sums(df: DataFrame) -> DataFrame:
    """(file, rows, checksum) of the files that ``df`` reads: the checksum adds up
    the rows' hashes, so it depends on their values and numbers, not their order."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    name = F.regexp_extract("_metadata.file_path", "[^/]*$", 0)
    return df.select(name.alias("file"), row.alias("h")).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("h").cast("string").alias("checksum"))


def write_verified(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, sort_by=None) -> str:
    """Write ``df`` as a new version under ``path`` and return the version's
    name: first the data, then a report (format, schema), last the manifest, which
    ``file_sums`` makes from the written files.  A version without a complete
    manifest does not exist for readers, so a write that dies halfway leaves the
    last version in place, and readers of that one are not disturbed."""
    spark = df.sparkSession
    version = f"{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    base = f"{path.rstrip('/')}/{version}"
    write_table(df, f"{base}/data", fmt, "error", partition_by, sort_by)
    save_report(spark, {"format": fmt, "schema": df.schema.json(), "sort_by": list(sort_by or [])}, f"{base}/about")
    file_sums(_data(spark, base)).write.json(f"{base}/manifest")
    return version


def _data(spark: SparkSession, base: str) -> DataFrame:
    about = load_report(spark, f"{base}/about")
    schema = T.StructType.fromJson(json.loads(about["schema"]))
    return spark.read.schema(schema).format(about["format"]).option("header", True).load(f"{base}/data").select(*schema.names)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions under ``path``, oldest first."""
    where, fs = _file_system(spark, path)
    if not fs.exists(where):
        return []
    done = lambda v: fs.exists(_file_system(spark, f"{path.rstrip('/')}/{v}/manifest/_SUCCESS")[0])
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(where)) if done(n))


def read_verified(spark: SparkSession, path: str, version: str | None = None, verify: bool = True) -> DataFrame:
    """The last complete version under ``path`` (or ``version``).  ``verify``: one
    pass compares every file's rows and checksum with the manifest; missing,
    changed and added files raise ``CorruptTable`` and at most 20 are named."""
    known = versions(spark, path)
    if not known or (version or known[-1]) not in known:
        raise FileNotFoundError(f"no complete version {version or ''} under {path}")
    base = f"{path.rstrip('/')}/{version or known[-1]}"
    df = _data(spark, base)
    if verify:
        want = spark.read.schema("file string, rows long, checksum string").json(f"{base}/manifest")
        have = file_sums(df).select("file", F.col("rows").alias("rows_now"), F.col("checksum").alias("checksum_now"))
        same = F.col("rows").eqNullSafe(F.col("rows_now")) & F.col("checksum").eqNullSafe(F.col("checksum_now"))
        bad = [r["file"] for r in want.join(have, "file", "full").where(~same).select("file").limit(20).collect()]
        if bad:
            raise CorruptTable(f"files differ from the manifest of {base}: {bad}")
    return df
