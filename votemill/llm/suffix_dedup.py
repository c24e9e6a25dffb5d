"""Removal of every byte under a string of ``length`` bytes that also starts elsewhere.

Suffixes are compared by their first ``length`` bytes only, and a bucket of
them at a time.

1. *Difference cover.*  Of each text the positions whose remainder modulo the
   period lies in a perfect difference set are sampled; two equal strings of
   ``length`` bytes, wherever they stand, have a sampled position at the same
   distance from their starts, with at least ``length - period + 1`` equal
   bytes after it.  Hashes of the samples are counted over all texts.  A suffix
   with no repeated sample in reach is unique and is settled.
2. *Buckets.*  The suffixes left fall into runs that share their least 32-byte
   string; a run travels as one piece of text to the bucket of that string, and
   equal runs travel once from each task.  Equal suffixes are in one bucket.
3. *One bucket at a time.*  Its samples (those of the cover, counted from the
   shared string, so that all suffixes of the bucket meet them at the same
   distance) are sorted by their ``length - period + 1`` bytes and ranked.  Then
   its suffixes are sorted: by a short prefix, ties by the rank of the first
   sample, then of the last that lies whole inside, then by the bytes behind it.
   Together these are all ``length`` bytes, so neighbours that agree are equal,
   and no hash decides.  Small buckets are sorted some at a time, the bucket
   leading.  Buckets are weighed before, by a hash of their string; where one
   would weigh more than ``bucket_bytes``, 128-bit prints of its suffixes are
   dealt out and counted instead, so no task holds it.
4. Each run (known by its bucket and a 128-bit print) gets its repeats back, and
   each text loses the bytes they cover.

Null and empty texts stay empty, texts shorter than ``length`` stay whole,
repeated rows and equal texts repeat each other, all of them lose the string (no
first one stays), ids may be null or repeat.  Very long texts are cut into runs
like any other; one text at a time is held whole.  An empty table gives no rows.
Kept columns travel as one struct and may have any name.  The input has to be
read again in the same order, as a table is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from votemill import runtime
from votemill.llm import caches, shared_keys as sk, textblocks as tb

U64 = np.uint64
#: Buckets are weighed in so many classes; in a task a run takes its text and about so many bytes, and so many for each start.
CLASSES, RUN_BYTES, START_BYTES = 1 << 20, 150, 160
#: Buckets are sorted together up to so many bytes of text.
LOT_BYTES = 1 << 18


@dataclass(frozen=True)
class Settings:
    length: int = 400
    #: order of the difference set; its period is q * q + q + 1
    q: int = 13
    #: bytes of the string that names a bucket
    anchor: int = 32
    #: memory that the buckets of one class may take in a task
    bucket_bytes: int = 48 << 20


def difference_set(q: int) -> list[int]:
    """q + 1 residues modulo q * q + q + 1 whose differences give every residue (q prime): the powers of a cubic root that lie in a plane."""
    period = q * q + q + 1
    for a, b, c in itertools.product(range(q), repeat=3):
        x, found = (1, 0, 0), []
        for i in range(period):
            if x[2] == 0:
                found.append(i)
            carry = x[2]  # times the root of t^3 = a t^2 + b t + c
            x = (carry * c % q, (x[0] + carry * b) % q, (x[1] + carry * a) % q)
        if len(found) == q + 1 and len({(i - j) % period for i in found for j in found}) == period:
            return found
    raise ValueError("no difference set of this order")


class Cover:
    def __init__(self, settings: Settings):
        self.period = settings.q ** 2 + settings.q + 1
        self.width = settings.length - self.period + 1
        if self.width < max(settings.anchor, self.period):
            raise ValueError("the period leaves too few bytes to name a sample")
        self.residues = np.array(difference_set(settings.q), np.int64)
        # of a suffix that starts so many bytes before the string of its bucket: distance to its first sample, and to the last within a period
        away = (np.arange(self.period)[None, :] - np.arange(settings.length)[:, None]) % self.period
        sampled = np.isin(away, self.residues)
        self.first, self.last = sampled.argmax(1), self.period - 1 - sampled[:, ::-1].argmax(1)
        #: bytes before the first sample or behind the last one, at most
        self.edge = int(max(self.first.max(), settings.length - self.width - self.last.min()))

    def samples(self, off: np.ndarray, length: int) -> np.ndarray:
        """Sampled positions of the texts that are long enough."""
        out = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            if b - a >= length:
                rounds = np.arange(a, b - self.width + 1, self.period)
                at = (rounds[:, None] + self.residues).ravel()
                out.append(at[at <= b - self.width])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sample_keys(column: pa.Array, cover: Cover, settings: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for low, buf, off in tb.text_blocks(column):
        at = cover.samples(off, settings.length)
        keys = tb.span_hash(tb.prefix_sums(buf), at, at + cover.width) if len(at) else np.zeros(0, U64)
        yield low, buf, off, at, keys


def _repeated_samples(rows: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("dedup")
        cover = Cover(settings)
        for block, table in tb.whole_blocks(batches, 0):
            keys = [k for *_, k in _sample_keys(tb.column(table, "text"), cover, settings)]
            keys = np.concatenate(keys)
            yield sk.packed_rows(block, keys, np.zeros(len(keys), np.int64), buckets)

    return sk.find_repeated(rows.select("text").mapInArrow(run, sk.PACKED), buckets)


def _spans(at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [start, end) of the union of [p, p + reach) for sorted p."""
    if not len(at):
        return at, at
    new = np.flatnonzero(np.diff(at) > reach) + 1
    return at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])] + reach


def _open_starts(off: np.ndarray, hit: np.ndarray, cover: Cover, length: int) -> np.ndarray:
    """Starts of strings of ``length`` bytes that have a repeated sample in reach."""
    n = int(off[-1])
    change = np.zeros(n + 2, np.int32)
    row = np.searchsorted(off, hit, "right") - 1
    first, last = np.maximum(hit - cover.period + 1, off[row]), np.minimum(hit, off[row + 1] - length)
    ok = first <= last
    np.add.at(change, first[ok], 1)
    np.add.at(change, last[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(change)[:n] > 0)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (first of equals) among each ``width`` neighbours, by first position."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = 32  # of each value the upper half, whatever else stands in the buffer: equal strings have their least at one place
    marked = (values >> U64(bits) << U64(bits)) | np.arange(len(values), dtype=U64)
    padded = np.full(-(-len(values) // width) * width, ~U64(0), U64)
    padded[:len(values)] = marked
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & U64((1 << bits) - 1)).astype(np.int64)


def _prints(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for two 64-bit hashes that take the bytes by different codes."""
    return tb.prefix_sums(buf), tb.prefix_sums(~buf)


def _print(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit prints of spans."""
    return np.stack([tb.span_hash(s, start, end) for s in sums], axis=1).view("V16").ravel()


def _binary(prints: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(prints), [None, pa.py_buffer(np.ascontiguousarray(prints))]).cast(pa.binary())


def runs(buf: np.ndarray, starts: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, bucket, print, place of the shared string from the first start) of the runs of ``starts`` that share their least anchor string."""
    sums = _prints(buf)
    anchors = tb.window_hash(sums[0], settings.anchor)
    least = _least(anchors, settings.length - settings.anchor + 1)[starts]
    new = np.flatnonzero((np.diff(starts) != 1) | (np.diff(least) != 0)) + 1
    a, b = np.concatenate([[0], new]), np.concatenate([new - 1, [len(starts) - 1]])
    first, last = starts[a], starts[b]
    return first, last, anchors[least[a]], _print(sums, first, last + settings.length), least[a] - first


def repeats(bucket: np.ndarray, texts: list[bytes], counts: np.ndarray, mid: np.ndarray, cover: Cover, settings: Settings) -> list[np.ndarray]:
    """Of whole buckets: the starts in each distinct run whose string stands elsewhere too.

    ``mid`` is where the string that names the bucket stands in each run.
    """
    length, width, edge = settings.length, cover.width, cover.edge
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    base, n = np.cumsum(sizes) - sizes, sizes - length + 1
    ends = np.cumsum(n)
    own = np.repeat(np.arange(len(texts)), n)
    place = np.arange(ends[-1]) - np.repeat(ends - n, n)
    before = mid[own] - place
    group = np.unique(bucket, return_inverse=True)[1][own] * length + before
    twice = counts[own] > 1
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(tied):
        start, before = (base[own] + place)[tied], before[tied]
        one, two = start + cover.first[before], start + cover.last[before]
        at = np.unique(np.concatenate([one, two]))
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, width)[at]).view(f"V{width}").ravel()
        rank = np.unique(strings, return_inverse=True)[1].astype(">u4")
        del strings
        key = np.empty((len(tied), 16 + 2 * edge), np.uint8)
        near = np.lib.stride_tricks.sliding_window_view(buf, edge)
        key[:, :8] = group[tied].astype(">u8").view(np.uint8).reshape(-1, 8)
        key[:, 8:8 + edge] = near[start]
        for k, sample in ((8, one), (12, two)):
            key[:, k + edge:k + edge + 4] = rank[np.searchsorted(at, sample)].view(np.uint8).reshape(-1, 4)
        key[:, 16 + edge:] = near[start + length - edge]
        order = np.argsort(key.view(f"V{key.shape[1]}").ravel(), kind="stable")
        key = key[order]
        same = (key[1:] == key[:-1]).all(axis=1)
        twice[tied[order[1:][same]]] = True
        twice[tied[order[:-1][same]]] = True
    return [place[b - k:b][twice[b - k:b]] for b, k in zip(ends.tolist(), n.tolist())]


def _pairs(at: np.ndarray) -> bytes:
    """Sorted numbers as maximal runs (first, last), 32 bits each."""
    new = np.flatnonzero(np.diff(at) != 1) + 1
    return np.stack([at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]], axis=1).astype(np.int32).tobytes()


def _settled(rows: DataFrame, samples: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """(uid, row, text, starts): all texts; ``starts`` the runs of starts still open, null where every suffix is settled."""
    row_type = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("idx", T.IntegerType()),
                           T.StructField("payload", T.BinaryType()), T.StructField("text", T.StringType()), T.StructField("row", row_type)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for block, part in tb.blocks(batches, 0):
            at = at if block == now else 0
            now, n = block, part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([2] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(np.arange(at, at + n), pa.int32()),
                                              pa.nulls(n, pa.binary()), *part.columns], names=schema.fieldNames())
            at += n

    texts = rows.select("text", "row").mapInArrow(numbered, schema)
    back = samples.select("block", "kind", "bucket", F.lit(0).alias("idx"), "payload", F.lit(None).cast("string").alias("text"), F.lit(None).cast(row_type).alias("row"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = tb.dealt(texts.unionByName(back), 2 * parts).sortWithinPartitions("block", "kind")
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField("row", row_type), T.StructField("text", T.StringType()), T.StructField("starts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("dedup")
        cover, now, names, known = Cover(settings), None, [], None
        for batch in batches:
            ids, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
                if a == b:
                    continue
                if ids[a] != now:
                    now, names, known = ids[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 1:
                    for bucket, payload in zip(part.column(2).to_pylist(), part.column(4).to_pylist()):
                        names.append(np.uint64(bucket) << U64(32) | np.unique(sk.unpack(payload, 3)[1]).astype(U64))
                    continue
                if known is None:
                    known = np.sort(np.concatenate(names)) if names else np.zeros(0, U64)
                starts: list[bytes | None] = []
                for _, buf, off, at, keys in _sample_keys(part.column(5), cover, settings):
                    bucket, prints = sk.split(keys, buckets)
                    name = bucket.astype(U64) << U64(32) | prints.astype(U64)
                    place = np.minimum(np.searchsorted(known, name), max(0, len(known) - 1))
                    hit = at[known[place] == name] if len(known) else at[:0]
                    left = _open_starts(off, hit, cover, settings.length)
                    edge = np.searchsorted(left, off)
                    starts += [_pairs(left[i:j] - o) if j > i else None for i, j, o in zip(edge[:-1].tolist(), edge[1:].tolist(), off[:-1].tolist())]
                uid = (part.column(0).to_numpy() << 13) + part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(uid), part.column(6), part.column(5), pa.array(starts, pa.binary())], names=out.fieldNames())

    return met.mapInArrow(run, out)


def _expand(pairs: bytes) -> np.ndarray:
    ends = np.frombuffer(pairs, np.int32).reshape(-1, 2).astype(np.int64)
    size = ends[:, 1] - ends[:, 0] + 1
    return np.repeat(ends[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _of_batch(batch: pa.RecordBatch, settings: Settings) -> Iterator[tuple[int, np.ndarray, tuple]]:
    """(uid, bytes, runs) of each text."""
    for r in range(batch.num_rows):
        buf = np.frombuffer(batch.column(1)[r].as_buffer(), np.uint8)
        yield batch.column(0)[r].as_py(), buf, runs(buf, _expand(batch.column(2)[r].as_py()), settings)


def _class(bucket: np.ndarray) -> np.ndarray:
    return (tb.mix(bucket.view(U64)) % U64(CLASSES)).astype(np.int64)


def _heavy_classes(texts: DataFrame, settings: Settings) -> np.ndarray:
    """The classes of buckets that weigh more than ``bucket_bytes``, counting equal runs once from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = np.zeros(CLASSES, np.int64), set()
        for batch in batches:
            for _, _, (first, last, bucket, content, _) in _of_batch(batch, settings):
                new = []
                for i, key in enumerate(content.tolist()):
                    if key not in known:
                        known.add(key)
                        new.append(i)
                starts = last[new] - first[new] + 1
                np.add.at(weights, _class(bucket[new]), starts * (1 + START_BYTES) + settings.length + RUN_BYTES)
        at = np.flatnonzero(weights)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["class", "weight"])

    weighed = texts.mapInArrow(run, "class long, weight long").groupBy("class").agg(F.sum("weight").alias("weight"))
    return np.sort(np.array([r["class"] for r in weighed.where(F.col("weight") > settings.bucket_bytes).select("class").collect()], np.int64))


def _codes(texts: DataFrame, settings: Settings, heavy: np.ndarray) -> DataFrame:
    """(bucket, content, place, code): the print of each string that starts in a run of a heavy class; of equal runs, from two in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            for _, buf, (first, last, bucket, content, _) in _of_batch(batch, settings):
                mine = []
                for i in np.flatnonzero(np.isin(_class(bucket), heavy)).tolist():
                    key = int(bucket[i]), bytes(content[i])
                    if again.get(key, 0) < 2:
                        again[key] = again.get(key, 0) + 1
                        mine.append(i)
                if not mine:
                    continue
                size = last[mine] - first[mine] + 1
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat(first[mine], size) + place
                code = _print(_prints(buf), start, start + settings.length)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket[mine], size).view(np.int64)), _binary(np.repeat(content[mine], size)), pa.array(place.astype(np.int32)), _binary(code)],
                                                 names=["bucket", "content", "place", "code"])

    return texts.mapInArrow(run, "bucket long, content binary, place int, code binary")


def _heavy_repeats(texts: DataFrame, settings: Settings, heavy: np.ndarray) -> DataFrame:
    """(bucket, content, found) as ``_bucket_repeats`` gives it, of the heavy classes."""
    codes = _codes(texts, settings, heavy)
    twice = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code")
    places = codes.join(twice, "code", "left_semi").groupBy("bucket", "content").agg(F.collect_set("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_pairs(np.sort(x.values.to_numpy())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["bucket", "content", "found"])

    return places.mapInArrow(run, "bucket long, content binary, found binary")


def _runs(texts: DataFrame, settings: Settings, with_text: bool, heavy: np.ndarray | None = None) -> DataFrame:
    """(uid, first, bucket, content), or with the text of each distinct run of a task and how often it has it: (bucket, content, mid, text, n), but for the heavy classes."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_of_batch(batch, settings))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([u for u, _, _ in found], [len(x[0]) for *_, x in found]).astype(np.int64)), *[pa.array(np.concatenate([x[k] for *_, x in found]).view(np.int64)) for k in (0, 2)],
                                                  _binary(np.concatenate([x[3] for *_, x in found]))],
                                                 names=["uid", "first", "bucket", "content"])

    def texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[tuple[int, bytes], int] = {}

        def lot(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()))], names=["bucket", "content", "mid", "text", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for _, buf, found in _of_batch(batch.slice(at, 256), settings):
                    if heavy is not None and len(heavy):
                        found = [x[~np.isin(_class(found[2]), heavy)] for x in found]
                    first, last, bucket, content, mid = found
                    keys = zip(bucket.view(np.int64).tolist(), content.tolist())
                    for a, b, key, m in zip(first.tolist(), (last + settings.length).tolist(), keys, mid.tolist()):
                        if key in again:
                            again[key] += 1
                        else:
                            again[key] = 0
                            rows.append((*key, m, buf[a:b].tobytes(), 1))
                if rows:
                    yield lot(rows)
        extra = [(*key, None, None, n) for key, n in again.items() if n]
        if extra:
            yield lot(extra)

    if with_text:
        return texts.mapInArrow(texts_once, "bucket long, content binary, mid int, text binary, n long")
    return texts.mapInArrow(narrow, "uid long, first long, bucket long, content binary")


def _bucket_repeats(pieces: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, content, found): of each distinct run, the runs of starts (from its first) that repeat."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover, now = Cover(settings), None
        held: dict[bytes, tuple] = {}
        lot: list[tuple] = []
        size = 0

        def close() -> int:
            """The bucket is whole: its runs join the lot unless nothing in it can repeat."""
            runs_of = [(now, content, *run) for content, run in held.items()]
            held.clear()
            if len(runs_of) < 2 and all(r[-1] < 2 for r in runs_of):
                return 0
            lot.extend(runs_of)
            return sum(len(r[3]) for r in runs_of)

        def sort() -> Iterator[pa.RecordBatch]:
            if lot:
                bucket, content, mid, texts, n = zip(*lot)
                found = repeats(np.array(bucket), list(texts), np.array(n), np.array(mid), cover, settings)
                out = [(b, c, _pairs(at)) for b, c, at in zip(bucket, content, found) if len(at)]
                lot.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "content", "found"])

        for batch in batches:
            for bucket, content, mid, text, n in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != now:
                    size += close()
                    now = bucket
                    if size > LOT_BYTES:
                        yield from sort()
                        size = 0
                had = held.get(content, (mid, text, 0))
                held[content] = (*(had[:2] if text is None else (mid, text)), had[2] + n)
        close()
        yield from sort()

    return pieces.repartition(2 * parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, content binary, found binary")


def _cut(texts: DataFrame, settings: Settings) -> DataFrame:
    """row, n_bytes, spans (start, end) removed, kept bytes; from row, text and ``hits``, an array of (first, found)."""
    row_type = texts.schema["row"].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("row", row_type), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, tb.SLICE_ROWS):
                batch, sizes, spans, kept = whole.slice(low, tb.SLICE_ROWS), [], [], []
                for r in range(batch.num_rows):
                    text, hits = batch.column(1)[r].as_buffer(), batch.column(2)[r].as_py()
                    raw = text.to_pybytes() if text is not None else b""
                    sizes.append(len(raw))
                    if not hits:
                        spans.append([])
                        kept.append(raw)
                        continue
                    at = np.sort(np.concatenate([h["first"] + _expand(h["found"]) for h in hits]))
                    start, end = _spans(at, settings.length)
                    spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
                    edges = [0, *itertools.chain.from_iterable(zip(start.tolist(), end.tolist())), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, arrow_span), pa.array(kept, pa.binary())], names=schema.fieldNames())

    return texts.select("row", "text", "hits").mapInArrow(run, schema)


def dedup(df: DataFrame, text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``row`` (struct of the kept columns), n_bytes, spans (start, end) removed, and the kept bytes."""
    spark = df.sparkSession
    runtime.ship(spark)
    buckets = sk.bucket_count(spark)
    rows = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"))
    samples = runtime.materialize(_repeated_samples(rows, settings, buckets), "samples")
    texts = runtime.materialize(_settled(rows, samples, settings, buckets), "texts")
    left = texts.where("starts is not null").select("uid", "text", "starts")
    heavy = _heavy_classes(left, settings)
    found = _bucket_repeats(_runs(left, settings, True, heavy), settings)
    found = runtime.materialize(found.unionByName(_heavy_repeats(left, settings, heavy)) if len(heavy) else found, "repeats")
    hits = _runs(left, settings, False).join(found, ["bucket", "content"]).groupBy("uid").agg(F.collect_list(F.struct("first", "found")).alias("hits"))
    none = F.lit(None).cast(hits.schema["hits"].dataType)
    whole = texts.where("starts is null").select("row", "text", none.alias("hits"))
    touched = texts.where("starts is not null").select("uid", "row", "text").join(hits, "uid", "left").select("row", "text", "hits")
    return _cut(whole, settings).unionByName(_cut(touched, settings))
