"""Resumable incremental loads: new landed files only, once, with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from votemill.sources.keyed import KeyedTable


def landed(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
           files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def run_available(stream: DataFrame, target: str, checkpoint: str,
                  shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append everything that has landed since the last run, then stop."""
    out = shape(stream) if shape else stream
    (out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
     .trigger(availableNow=True).start(target).awaitTermination())


def deduplicated(keys: list[str], event_time: str | None = None, lateness: str = "30 days"):
    """Shape for :func:`run_available` that keeps one row per key.

    Without an event time the keys seen stay in the state for good, which is
    what keeps reruns exact; with one, keys older than ``lateness`` are let go.
    """
    def shape(df: DataFrame) -> DataFrame:
        if event_time is None:
            return df.dropDuplicates(keys)
        return df.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)

    return shape


def run_upserts(stream: DataFrame, table: KeyedTable, checkpoint: str, order: list[str] | None = None) -> KeyedTable:
    """Write each micro-batch as one lot of a keyed table; its rows replace those of the same key.

    Batches carry the number of the checkpoint's run, so a new or lost
    checkpoint adds to the table and never takes its batches for known ones.
    """
    return _run(stream, table, checkpoint, lambda now, df, batch, run: now.upsert(df, batch, run, order))


def run_first_seen(stream: DataFrame, table: KeyedTable, checkpoint: str, order: list[str]) -> KeyedTable:
    """Keep of each key the first row by source order, and let later loads add new keys only.

    Keys are held against the filters and buckets of the stored table instead
    of a stream state that would grow for good; a replayed batch adds nothing.
    """
    return _run(stream, table, checkpoint, lambda now, df, batch, run: now.add_new(df, order, batch, run))


def _run(stream: DataFrame, table: KeyedTable, checkpoint: str, load: Callable[[KeyedTable, DataFrame, int, int], KeyedTable]) -> KeyedTable:
    run, now = table.run_number(checkpoint), [table.newest()]

    def store(df: DataFrame, batch: int) -> None:
        now[0] = load(now[0].newest(), df, batch, run)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    return now[0]
