"""Sinks with a manifest, guards and encodings."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from pitchline.session import scratch_path
from pitchline.sources.io import CorruptTable, MissingColumns, ensure_columns, ensure_path, read_csv, read_verified, versions, write_verified


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(i, f"t{i % 3}", None if i == 4 else i / 2, "a\"b,c\nñ") for i in range(40)], "id long, team string, x double, `odd name` string")


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_versions_round_trip(spark, table, fmt):
    path = scratch_path(spark, "versions")
    assert versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        read_verified(spark, path)
    first = write_verified(table, path, fmt, partition_by=["team"], sort_by=["id"])
    second = write_verified(table.where("id < 10").union(table.where("id < 2")), path, fmt)
    assert versions(spark, path) == [first, second]
    assert read_verified(spark, path).count() == 12
    rows = lambda d: sorted(map(repr, d.select("id", "team", "x", "`odd name`").collect()))
    assert rows(read_verified(spark, path, first)) == rows(table)
    assert rows(write_and_read(spark, table.where("false"))) == []


def write_and_read(spark, df):
    path = scratch_path(spark, "one")
    write_verified(df, path)
    return read_verified(spark, path)


def test_changes_are_found(spark, table):
    path = scratch_path(spark, "changed")
    v = write_verified(table.repartition(3), path)
    data = f"{path}/{v}/data"
    table.where("id = 7").withColumn("x", F.lit(-1.0)).write.mode("append").parquet(data)      # a file more
    with pytest.raises(CorruptTable):
        read_verified(spark, path)
    assert read_verified(spark, path, verify=False).count() == 41
    v = write_verified(table.repartition(3), path)
    files = glob.glob(f"{path}/{v}/data/part-*")
    os.replace(files[0], files[1])                                                              # one less, one changed
    for crc in glob.glob(f"{path}/{v}/data/.part-*.crc"):
        os.remove(crc)
    with pytest.raises(CorruptTable):
        read_verified(spark, path)


def test_a_write_that_dies_is_no_version(spark, table):
    path = scratch_path(spark, "dies")
    v = write_verified(table, path)
    broken = table.withColumn("x", F.when(F.col("id") == 30, F.raise_error(F.lit("planted")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="planted"):
        write_verified(broken, path)
    assert versions(spark, path) == [v] and read_verified(spark, path).count() == 40


def test_guards(spark, table):
    with pytest.raises(FileNotFoundError, match="/no/such"):
        read_csv(spark, "/no/such/file.csv")
    with pytest.raises(FileNotFoundError):
        ensure_path(spark, "/no/such/*")
    with pytest.raises(MissingColumns, match="kickoff"):
        ensure_columns(table, ["id", "kickoff"], "matches")


def test_each_file_in_its_encoding(spark):
    path = scratch_path(spark, "enc")
    names = spark.createDataFrame([("Málaga",), ("Köln",), ("Plain",)], "team string").coalesce(1)
    for name, enc in (("a", "ISO-8859-1"), ("b", "UTF-8")):
        names.write.option("header", True).option("encoding", enc).csv(f"{path}/{name}")
    got = read_csv(spark, f"{path}/*", "team string").collect()
    assert sorted(r[0] for r in got) == ["Köln", "Köln", "Málaga", "Málaga", "Plain", "Plain"]
