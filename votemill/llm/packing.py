"""Packing documents into sequences by minimum bin slack.

Only lengths matter, and there are at most ``size`` of them, so the plan is
made on the counts of lengths: the longest piece left opens a sequence, a
bitset dynamic programme over the lengths still there finds the combination
that fills it fullest, and that combination is used as often as the counts
allow before it is taken out.  Pieces are then ranked within their length, by
salted windows, and each rank looks up its place in the plan.

A document's tokens end with ``end_id``; a null or empty text is that token
alone.  Only documents longer than a sequence are cut, into full pieces, of
which the first may be shorter.  Repeated rows are packed one by one; ids may
be null or repeat, as rows carry a number of their own.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from votemill import runtime
from votemill.llm import caches
from votemill.llm.pretokens import PreTokens


#: The character that stands for each byte in a byte-level vocabulary: visible ones for themselves, the others from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}

_SPACE = chr(BYTE_CHARACTERS[0x20])

#: Stretches of text that a worker remembers (see :class:`PreTokens`), some 200 bytes each.
MEMORY = 1_000_000


class Ids:
    """Token ids of texts by the tokenizer's library, as little-endian unsigned 32-bit bytes.

    The library merges each distinct pre-token once; texts that hold one of the
    special tokens' strings, or cannot be cut into stretches, go through it whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.values = PreTokens(public_tokenizers.PATTERN, self._merge, b"".join, self._whole, memory=MEMORY)

    def _merge(self, piece: str) -> bytes:
        if piece.isascii() and piece.lstrip(" ").isalpha():
            mapped = piece.replace(" ", _SPACE)
        else:
            mapped = piece.encode("utf-8", "replace").decode("latin-1").translate(BYTE_CHARACTERS)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(self.values(text))


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def cuts(length: int, size: int) -> list[int]:
    """Starts of the pieces of a document of ``length`` tokens."""
    return [0, *range((length - 1) % size + 1, length, size)]


def tokenize(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, end_id: int = 2, size: int = 1024, memory: int = MEMORY) -> DataFrame:
    """A row per piece: ``row`` (struct of the kept columns), uid, piece, start, length, ids (little-endian unsigned 32-bit bytes)."""
    runtime.ship(df.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("uid", T.LongType()), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("packing", _ids.cache_clear)
        encode, uid = _ids(path), TaskContext.get().partitionId() << 40
        encode.values.memory = memory
        for batch in batches:
            texts = batch.column(1)
            for low in range(0, batch.num_rows, 500):
                source, uids, piece, start, length, ids = [], [], [], [], [], []
                for r in range(low, min(low + 500, batch.num_rows)):
                    data = encode(texts[r].as_py() or "") + end
                    at = cuts(len(data) // 4, size)
                    for k, (a, b) in enumerate(zip(at, [*at[1:], len(data) // 4])):
                        source.append(r)
                        uids.append(uid)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(data[4 * a:4 * b])
                    uid += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source)), pa.array(uids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                                  pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def fullest(counts: list[int], slack: int) -> dict[int, int]:
    """The combination of lengths, each at most as often as it is there, with the largest sum up to ``slack``; longer lengths are preferred."""
    mask, reach, stages = (1 << (slack + 1)) - 1, 1, []
    for length in range(min(slack, len(counts) - 1), 0, -1):
        left = min(counts[length], slack // length)
        if not left:
            continue
        stages.append((length, reach))
        step = 1
        while left:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> slack & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        used = 0
        while not before >> total & 1:
            total -= length
            used += 1
        if used:
            out[length] = used
    return out


def plan(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(combination of lengths, times used), until every piece has its sequence."""
    counts = [0] * (size + 1)
    for length, n in histogram.items():
        counts[length] += n
    out = []
    for longest in range(size, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            combination = fullest(counts, size - longest)
            counts[longest] += 1
            combination[longest] = combination.get(longest, 0) + 1
            times = min(counts[length] // n for length, n in combination.items())
            for length, n in combination.items():
                counts[length] -= n * times
            out.append((combination, times))
    return out


def places(steps: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, offset), ordered by length and rank."""
    rank: dict[int, int] = {}
    sequence, rows = 0, []
    for combination, times in steps:
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            rows.append((length, rank.get(length, 0), sequence, n, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, total: int, rows_per_salt: int = 50_000) -> DataFrame:
    """``rank`` from 0 within each length, by windows of about ``rows_per_salt`` rows at most, whatever the lengths."""
    salts = max(64, total // rows_per_salt)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("uid", "piece"), F.lit(salts)))
    numbered = salted.withColumn("within", F.row_number().over(W.partitionBy("length", "salt").orderBy("uid", "piece")) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return numbered.join(shifts, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("shift")).drop("salt", "within", "shift")


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """The given pieces (uid, piece, length from 1 to ``size`` and any other columns) with ``sequence_id`` and ``offset``.

    The pieces are written to the shared folder first; columns that only the
    caller needs later, such as the ids, may be left out and joined by (uid, piece).
    """
    spark = pieces.sparkSession
    written = runtime.materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    table = places(plan(histogram, size))
    key = (table[:, 0] << 44) | table[:, 1]
    found = ranked(written, sum(histogram.values()))
    schema = T.StructType([*[f for f in found.schema.fields if f.name != "rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    length_at, rank_at = found.columns.index("length"), found.columns.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (length_at, rank_at))
            row = table[np.searchsorted(key, (length << 44) | rank, "right") - 1]
            nth = rank - row[:, 1]
            new = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != rank_at], *new], names=schema.fieldNames())

    return found.mapInArrow(run, schema) if histogram else spark.createDataFrame([], schema)
