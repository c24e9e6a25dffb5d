"""Five stages from raw documents to packed training sequences; each stage works on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from votemill import runtime
from votemill.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("quality rules", stages.clean_lines),
    ("n-gram Jaccard join", stages.one_of_each_group),
    ("suffix-array dedup", stages.cut_repeats),
    ("best-fit packing", stages.packed),
]

#: The stages train a model and tokenize; SQL cannot express them, tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
