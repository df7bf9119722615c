"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every pitchline job relies on.  Kept small on purpose: the rest is
# left to the cluster's own defaults.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# HotSpot never compiles a method of more bytes; Spark's own default is 65,535.
METHOD_BYTES = 8_000


def limit_generated_methods(spark: SparkSession) -> None:
    """Where whole-stage code would hold a method that HotSpot leaves interpreted
    (projections of many columns), Spark runs the operators one by one, in small
    compiled methods.  A session that asks for less is left alone."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > METHOD_BYTES:
        spark.conf.set(key, str(METHOD_BYTES))


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pitchline", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with pitchline's base configuration.

    ``master`` is only applied when given: on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        # local mode: keep the driver on loopback, no UI
        builder = builder.config("spark.driver.host", "127.0.0.1")
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("PITCHLINE_DRIVER_MEMORY", "16g"))
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in BASE_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    limit_generated_methods(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and read from the session.  Only
    when it is unset in local mode do we pick a fresh local folder: executors
    elsewhere would not see it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="pitchline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.conf.get("spark.checkpoint.dir", None) or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    for scope in _SCOPES:
        scope.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables made inside are removed at the end, but for those that are
    taken off the list it gives."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove_scratch(spark, path)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more, on any file system."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not path.startswith(base + "/"):
        raise ValueError(f"{path} is not a scratch table")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pitchline`` importable on executors (pandas UDFs, grouped maps
    and ``mapInPandas`` steps unpickle functions that live in it): zip the
    package once per application and register it with ``addPyFile``, the
    same mechanism as ``--py-files``.  Idempotent."""
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import pitchline
    pkg_dir = os.path.dirname(os.path.abspath(pitchline.__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="pitchline-pyfiles-"), "pitchline.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, dirs, files in os.walk(pkg_dir):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
