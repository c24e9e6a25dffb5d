"""Which 64-bit keys of many texts occur more than once, in two exchanges of packed rows.

A task packs the keys of a *block* of texts by key bucket: per bucket one
binary row with a 32-bit print of each key and the number of its text in the
block.  A bucket's rows meet in one task, which finds the prints that occur at
least twice anywhere and sends each block its own back, with their counts.
Bucket and print together are the identity of a key from there on (about 40
bits on small clusters; buckets grow with the shuffle partitions, so the share
of keys that coincide by chance stays below a thousandth).

Texts of a block are numbered in the order of the input, so the input has to be
a table or anything else that Spark reads again in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: A block ends at so many keys or texts.
BLOCK_KEYS, BLOCK_ROWS = 1_000_000, 1 << 15
PACKED = "kind int, bucket int, block long, payload binary"


def bucket_count(spark: SparkSession) -> int:
    return min(1 << 15, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def planes(values: np.ndarray) -> bytes:
    """Little-endian bytes with equal places together, which compresses well when values are small or alike."""
    raw = np.ascontiguousarray(values)
    return np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers of one length."""
    return b"".join(planes(c.astype(np.uint32)) for c in columns)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    n = len(data) // (4 * columns)
    return [unplanes(data[4 * n * k:4 * n * (k + 1)], np.uint32, n) for k in range(columns)]


def split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, print) of each key."""
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64), keys.astype(np.uint32)


def packed_rows(block: int, keys: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of PACKED, kind 1: the keys of one block by bucket, in the order of its texts."""
    bucket, prints = split(keys, buckets)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    bucket, prints, rows = bucket[order], prints[order], rows[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    start, end = np.concatenate([[0], edges]), np.concatenate([edges, [len(bucket)]])
    if not len(bucket):
        start = end = np.zeros(0, np.int64)
    # texts come in order: the step to the next is small
    payload = [pack(prints[a:b], np.diff(rows[a:b], prepend=0)) for a, b in zip(start, end)]
    return pa.RecordBatch.from_arrays([pa.array([1] * len(start), pa.int32()), pa.array(bucket[start], pa.int32()), pa.array([block] * len(start), pa.int64()),
                                       pa.array(payload, pa.binary())], names=["kind", "bucket", "block", "payload"])


def repeated(blobs: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(block, texts, prints, counts) of one bucket's keys that occur at least twice, packed, for each block that has any."""
    parts = [unpack(data, 2) for _, data in blobs]
    prints = np.concatenate([p for p, _ in parts])
    sizes = np.array([len(p) for p, _ in parts])
    rows = np.concatenate([np.cumsum(r) for _, r in parts]).astype(np.uint32)
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.diff(np.append(first, len(ordered)))
    times = np.empty(len(prints), np.uint32)
    times[order] = np.repeat(count, count).astype(np.uint32)
    kept = np.flatnonzero(times > 1)
    edges = np.searchsorted(kept, np.concatenate([[0], np.cumsum(sizes)]))
    for k, (block, _) in enumerate(blobs):
        own = kept[edges[k]:edges[k + 1]]
        if len(own):
            yield block, pack(np.diff(rows[own].astype(np.int64), prepend=0), prints[own], times[own])


def find_repeated(packed: DataFrame, buckets: int) -> DataFrame:
    """From rows of PACKED: kind 1 rows come back as ``repeated`` packs them, all others pass unchanged."""
    names = packed.columns
    places = [names.index(c) for c in ("kind", "bucket", "block", "payload")]
    schema = packed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(repeated(held)) if held else []
            if found:
                n = len(found)
                columns = {"kind": pa.array([1] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()),
                           "block": pa.array([b for b, _ in found], pa.int64()), "payload": pa.array([p for _, p in found], pa.binary())}
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, batch_schema.field(i).type) for i, c in enumerate(names)], schema=batch_schema)

        batch_schema = None
        for batch in batches:
            batch_schema = batch.schema
            kinds, keys = batch.column(places[0]).to_numpy(), batch.column(places[1]).to_numpy()
            other = np.flatnonzero(kinds != 1)
            if len(other):
                yield batch.take(pa.array(other))
            for r in np.flatnonzero(kinds == 1).tolist():
                if keys[r] != bucket:
                    yield from flush()
                    held, bucket = [], int(keys[r])
                held.append((batch.column(places[2])[r].as_py(), batch.column(places[3])[r].as_py()))
        yield from flush()

    dealt = packed.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(run, schema)
