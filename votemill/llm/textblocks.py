"""Whole texts as byte buffers: rows, words, lines and hashes in numpy, a few megabytes at a time.

Null texts count as empty.  A word is a maximal run of bytes other than
0x20 and 0x09-0x0D.  Hashes are 64-bit polynomials over a fixed random byte
table, finished by a bit mixer, so any span of a buffer is hashed from two
prefix sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from votemill import runtime

BLOCK_BYTES = 2 << 20
SLICE_ROWS = 1_000
#: A block of texts that is worked on together ends at so many texts or bytes.
GROUP_ROWS, GROUP_BYTES = 4_096, 24 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(33)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, BLOCK_BYTES + 1), base, U64)
        grown[0] = 1
        have = np.cumprod(grown, dtype=U64)
        if n <= 4 * BLOCK_BYTES:  # a single very long text does not stay in memory
            _powers[base] = have
    return have[:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """H with ``span_hash`` of any [s, e) = f(H[s], H[e])."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE_CODES[buf] * _power(_BASE, len(buf)), out=out[1:], dtype=U64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, mixed: bool = True) -> np.ndarray:
    raw = (sums[end] - sums[start]) * _power(_BASE_INVERSE, len(sums))[start]
    return mix(raw) if mixed else raw


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` bytes, by start."""
    n = max(0, len(sums) - width)
    return mix((sums[width:width + n] - sums[:n]) * _power(_BASE_INVERSE, len(sums))[:n])


def text_blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows; a row is never cut."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        to = max(row + 1, int(np.searchsorted(off, off[row] + max_bytes, "right")) - 1)
        yield row, raw[off[row]:off[to]], off[row:to + 1] - off[row]
        row = to


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word."""
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~solid[:-1]
    after[:-1] |= ~solid[1:]
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each piece between line feeds; an empty text has one empty line."""
    feed = np.flatnonzero(buf == 10)
    feed_row = np.searchsorted(off, feed, "right") - 1
    rows = np.arange(len(off) - 1)
    row = np.concatenate([rows, feed_row])
    start, end = np.concatenate([off[:-1], feed + 1]), np.concatenate([off[1:], feed])
    by_start, by_end = np.lexsort((start, row)), np.lexsort((end, row))
    return start[by_start], end[by_end], row[by_start]


def combine(codes: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every ``width`` neighbouring codes, by first position."""
    n = max(0, len(codes) - width + 1)
    out = np.full(n, (width * 0x9E3779B97F4A7C15) % (1 << 64), U64)
    for j in range(width):
        out += codes[j:j + n] * U64(pow(_BASE, j + 1, 1 << 64))
    return mix(out)


def shingles(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every ``width``-word shingle, repeats included; a shorter text gives one of all its words."""
    start, end, row = words(buf, off)
    codes = span_hash(prefix_sums(buf), start, end)
    whole = combine(codes, width)
    n = len(whole)
    inside = row[:n] == row[width - 1:width - 1 + n]
    count = np.bincount(row, minlength=len(off) - 1)
    out, out_row = [whole[inside]], [row[:n][inside]]
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            out.append(combine(codes, k)[first[short]])
            out_row.append(short)
    return np.concatenate(out), np.concatenate(out_row)


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n).astype(np.int64)


def distinct_per_row(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs, ordered by row then code."""
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    return codes[first], row[first]


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) with cuts that depend on the order of rows alone; a block may come in several parts."""
    block, rows, size = TaskContext.get().partitionId() << 24, 0, 0
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text_at)).fill_null(0).to_numpy()
        low = 0
        for r, length in enumerate(lengths.tolist()):
            if rows and (rows >= GROUP_ROWS or size + length > GROUP_BYTES):
                if r > low:
                    yield block, batch.slice(low, r - low)
                block, rows, size, low = block + 1, 0, 0, r
            rows, size = rows + 1, size + length
        if batch.num_rows > low:
            yield block, batch.slice(low, batch.num_rows - low)


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows of blocks, column ``block``, dealt out by number: as good as one block a task where there are tasks enough.

    Blocks are few and large, so dealing them by hash would give some tasks
    several and others none.
    """
    step = 7919  # prime: second and later blocks of the tasks that made them go to places of their own
    place = F.shiftright("block", 24) + F.col("block").bitwiseAND(F.lit((1 << 24) - 1)) * step
    return df.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int"))


def whole_blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[int, pa.Table]]:
    now, parts = None, []
    for block, part in blocks(batches, text_at):
        if parts and block != now:
            yield now, pa.Table.from_batches(parts)
            parts = []
        now = block
        parts.append(part)
    if parts:
        yield now, pa.Table.from_batches(parts)


def column(table: pa.Table, name: str) -> pa.Array:
    merged = table.column(name).combine_chunks()
    return merged.combine_chunks() if isinstance(merged, pa.ChunkedArray) else merged


def map_texts(df: DataFrame, text: str, keep: list[str], fn: Callable[[pa.Array], list[pa.Array]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """``row`` (a struct of the kept columns) and the columns ``fn`` makes of each batch of texts.

    The kept columns travel as one struct, so no name of theirs can clash with a result.
    """
    runtime.ship(df.sparkSession)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *[T.StructField(n, t) for n, t in fields]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):  # results are made and sent in small lots
                part = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *fn(part.column(1))], names=names)

    return rows.mapInArrow(run, schema)
