"""Distinct counts out of united sketches: error, refreshed parts, nulls, empty tables."""

import glob
import os

from pyspark.sql import functions as F

from votemill.operators import sketches


def test_error_and_refresh(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(300_000).select((F.col("id") % 4 + 2000).alias("year"), F.when(F.col("id") % 3 > 0, "a").alias("g"), (F.col("id") % 90_001).alias("v"))
    sketches.refresh(rows.where("year < 2003 or v < 10"), path, "year", ["g"], ["v"])
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/year=200[0-2]/*.parquet")}
    sketches.refresh(rows.where("year = 2003"), path, "year", ["g"], ["v"])
    assert before == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/year=200[0-2]/*.parquet")}
    exact = {r.g: (r.n, r.d) for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()}
    got = {r.g: (r.n_rows, r.v) for r in sketches.distinct_counts(spark, path, ["g"], ["v"]).collect()}
    assert set(got) == {None, "a"}
    for g, (n, d) in exact.items():
        assert got[g][0] == n and abs(got[g][1] - d) <= 4 * sketches.relative_error() * d


def test_few_values_nulls_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "a", 6), (2, "b", None)], "year int, g string, v int")
    sketches.refresh(df, path, "year", ["g"], ["v"])
    sketches.refresh(df.limit(0), path, "year", ["g"], ["v"])
    assert {(r.g, r.n_rows, r.v) for r in sketches.distinct_counts(spark, path, ["g"], ["v"]).collect()} == {("a", 3, 2), ("b", 1, 0)}
