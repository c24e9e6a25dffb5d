"""Distinct counts that add up: a written table of sketches per part (a year), refreshed part by part.

A sketch is bounded (2 ** ``lg`` registers of six bits at most) however many
values it has seen, and sketches of parts are united without reading the parts
again.  Rows are counted exactly beside it.  Nulls count as no value; the
relative standard error of an estimate is about 1.04 / sqrt(2 ** lg), 0.8 % as
given; sketches of few values are all but exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from votemill.sources.sinks import rebuild

LG = 14


def relative_error(lg: int = LG) -> float:
    return 1.04 / (1 << lg) ** 0.5


def refresh(df: DataFrame, path: str, part: str, groups: list[str], values: list[str], lg: int = LG) -> None:
    """Writes rows and sketches of the parts that ``df`` holds, whole; other parts stay as they are."""
    sketches = [F.hll_sketch_agg(F.col(v), F.lit(lg)).alias(v) for v in values]
    rebuild(df.groupBy(part, *groups).agg(F.count(F.lit(1)).alias("n_rows"), *sketches), path, [part])


def distinct_counts(spark: SparkSession, path: str, groups: list[str], values: list[str]) -> DataFrame:
    """Per group over all parts: n_rows, exact, and the estimated number of distinct ``values``."""
    united = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(v)), F.lit(0)).alias(v) for v in values]
    return spark.read.parquet(path).groupBy(*groups).agg(F.sum("n_rows").alias("n_rows"), *united)
