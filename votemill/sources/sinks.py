"""Writers: full rebuild, job progress, work lists; keyed tables are in ``keyed``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from votemill.operators.relational import fold_updates


def rebuild(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a whole table; with partitions, only those present in ``df``."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


PROGRESS_COLUMNS = ["last_pk", "last_page", "status", "n_items", "note"]


def progress_state(log: DataFrame) -> DataFrame:
    """State per job from its update log; a null in an update keeps the older value."""
    state = fold_updates(log, "job", "seq", PROGRESS_COLUMNS)
    return state.withColumn("status", F.coalesce("status", F.lit("running"))) \
        .withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def write_work_list(df: DataFrame, path: str) -> None:
    """Work list as JSON lines."""
    df.write.mode("overwrite").json(path)
