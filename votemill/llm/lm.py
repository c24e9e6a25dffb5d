"""Scoring texts with a log-bilinear model against the unigram base.

Words are lower-cased (A-Z) and every text ends with an end token.  Counts
come from all training texts: a task packs the distinct words of a block of
texts by key bucket, a bucket's rows meet in one task, and each block gets the
counts of its own words back.  The most frequent words have a class each, all
others share classes by their last letters; the model of ``lbl`` gives the
class after the two tokens before, and a word within a shared class has its
share of that class's counts.  Every task trains on its own texts from the
same start, and the parameters are averaged by tokens.

Null and empty texts are the end token alone.  Without training texts every
count is 0 and the model is the untrained one.  Repeated rows count as often as
they stand there.  The input has to be read again in the same order, as a table
is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from votemill import runtime
from votemill.llm import caches, lbl, shared_keys as sk, textblocks as tb

U64 = np.uint64
END = U64(0x454E4420 << 24)


def tokens(column: pa.Array, groups: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(key, row) of the tokens of each text in order, its end included, and the number of rows.

    A key is a word's hash; its remainder by ``groups`` comes from the last letters.
    """
    keys, rows, n, by = [], [], 0, U64(groups)
    for low, buf, off in tb.text_blocks(column):
        buf = tb.LOWER[buf]
        start, end, row = tb.words(buf, off)
        sums = tb.prefix_sums(buf)
        code = tb.span_hash(sums, start, end) // by * by + tb.span_hash(sums, np.maximum(start, end - 3), end) % by
        here = len(off) - 1
        code, row = np.concatenate([code, np.full(here, END // by * by)]), np.concatenate([row, np.arange(here)])
        order = np.argsort(row, kind="stable")
        keys.append(code[order])
        rows.append(row[order] + low)
        n = low + here
    return np.concatenate(keys) if keys else np.zeros(0, U64), np.concatenate(rows) if rows else np.zeros(0, np.int64), n


def _most(lots: list, n: int) -> list[np.ndarray]:
    """The ``n`` keys with the largest counts of several (keys, counts); equal counts go to the smaller key."""
    keys, counts = np.concatenate([k for k, _ in lots]), np.concatenate([c for _, c in lots])
    pick = np.lexsort((keys, -counts))[:n]
    return [keys[pick], counts[pick]]


def _packed(pair: list[np.ndarray]) -> bytes:
    return pair[0].astype("<u8").tobytes() + pair[1].astype("<i8").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return np.frombuffer(data[:half], "<u8"), np.frombuffer(data[half:], "<i8")


def most_frequent(counted: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` most frequent words of all tasks, merged in two steps; no list is longer than ``n``."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, np.int64)]
        for batch in batches:
            for data in batch.column(0).to_pylist():
                best = _most([best, _unpacked(data)], n)
        yield pa.RecordBatch.from_arrays([pa.array([_packed(best)], pa.binary())], names=["payload"])

    lists = counted.where("kind = 2").select("payload")
    row = lists.repartition(16).mapInArrow(merge, "payload binary").repartition(1).mapInArrow(merge, "payload binary").first()
    return _unpacked(row["payload"]) if row else (np.zeros(0, U64), np.zeros(0, np.int64))


def count_words(rows: DataFrame, settings: lbl.Settings, buckets: int) -> DataFrame:
    """kind 1: (block, bucket, payload) the training counts of a block's distinct words, by key; kind 2: the most frequent words of a task, packed; kind 3: (key, count, distinct) totals of a group."""
    schema = "kind int, bucket int, block long, payload binary"

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("lm", _scorer.cache_clear)
        for block, table in tb.whole_blocks(batches, 0):
            keys, row, _ = tokens(tb.column(table, "text"), settings.groups)
            learnt = ~tb.column(table, "held").to_numpy(zero_copy_only=False)[row]
            words, place = np.unique(keys, return_inverse=True)
            count = np.bincount(place, weights=learnt, minlength=len(words))
            bucket, _ = sk.split(words, buckets)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges))
            payload = [sk.planes(words[edges[b]:edges[b + 1]]) + sk.pack(count[edges[b]:edges[b + 1]]) for b in used]
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array(payload, pa.binary())],
                                             names=["kind", "bucket", "block", "payload"])

    out = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("key", pa.int64()), ("count", pa.int64()), ("distinct", pa.int64())])

    def per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            parts = [(sk.unplanes(data, U64, len(data) // 12), sk.unpack(data[len(data) // 12 * 8:], 1)[0]) for _, data in held]
            words, place = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([c for _, c in parts]), minlength=len(words)).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum([len(w) for w, _ in parts])])
            lots = [(block, sk.planes(total[place[edges[i]:edges[i + 1]]].astype(np.uint64))) for i, (block, _) in enumerate(held)]
            n = len(lots)
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([now] * n, pa.int32()), pa.array([b for b, _ in lots], pa.int64()), pa.array([p for _, p in lots], pa.binary()),
                                              *[pa.nulls(n, pa.int64())] * 3], schema=out)
            seen = np.flatnonzero(total)
            best[:] = _most([best, (words[seen], total[seen])], settings.words)
            group = (words % U64(settings.groups)).astype(np.int64)
            sums[0] += np.bincount(group, weights=total, minlength=settings.groups).astype(np.int64)
            sums[1] += np.bincount(group[seen], minlength=settings.groups)

        best: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, np.int64)]
        sums = np.zeros((2, settings.groups), np.int64)
        for batch in batches:
            for bucket, block, payload in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                if bucket != now:
                    yield from flush()
                    held, now = [], bucket
                held.append((block, payload))
        yield from flush()
        n = settings.groups
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.array([_packed(best)], pa.binary()), *[pa.nulls(1, pa.int64())] * 3], schema=out)
        yield pa.RecordBatch.from_arrays([pa.array([3] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(n)), pa.array(sums[0]), pa.array(sums[1])], schema=out)

    packed = rows.select("text", "held").mapInArrow(per_block, schema)
    dealt = packed.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(per_bucket, "kind int, bucket int, block long, payload binary, key long, count long, distinct long")


class Vocabulary:
    """Classes and totals: ``top`` keys in order, their counts, counts and distinct words of each shared class."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, groups: dict[int, tuple[int, int]], settings: lbl.Settings):
        order = np.argsort(keys)
        self.top, self.count, self.settings = keys[order], counts[order], settings
        self.n, self.v = sum(c for c, _ in groups.values()), sum(d for _, d in groups.values())
        own = (self.top % U64(settings.groups)).astype(np.int64)
        self.rest = np.array([groups.get(g, (0, 0)) for g in range(settings.groups)], np.int64).reshape(-1, 2)
        self.rest -= np.stack([np.bincount(own, weights=self.count, minlength=settings.groups), np.bincount(own, minlength=settings.groups)], axis=1).astype(np.int64)

    def classes(self, keys: np.ndarray) -> np.ndarray:
        shared = self.settings.words + (keys % U64(self.settings.groups)).astype(np.int64)
        if not len(self.top):
            return shared
        at = np.minimum(np.searchsorted(self.top, keys), len(self.top) - 1)
        return np.where(self.top[at] == keys, at, shared)

    def share(self) -> np.ndarray:
        counts = np.zeros(self.settings.classes)
        counts[:len(self.count)] = self.count
        counts[self.settings.words:] = self.rest[:, 0]
        return (counts + 1) / (counts + 1).sum()


def train(rows: DataFrame, vocabulary: Vocabulary) -> lbl.Parameters:
    """Parameters averaged, by tokens, over the tasks that train on the texts not held out."""
    settings, share = vocabulary.settings, vocabulary.share()
    begin = lbl.start(share, settings)
    lot = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = lbl.Trainer(begin, share, settings, TaskContext.get().partitionId())
        for _, part in tb.blocks(batches, 0):
            for at in range(0, part.num_rows, 512):
                keys, row, _ = tokens(part.column(0).slice(at, 512), settings.groups)
                if len(keys):
                    classes = vocabulary.classes(keys)
                    trainer.train(*lbl.contexts(classes, row, settings.classes), classes)
        if trainer.tokens:
            for k, array in enumerate(trainer.p.arrays()):
                at = list(range(0, len(array), lot))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([trainer.tokens] * len(at), pa.int64()),
                                                  pa.array([array[i:i + lot].astype("<f4").tobytes() for i in at], pa.binary())], names=["array", "at", "tokens", "rows"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}  # at most one entry for each lot of the model
        for batch in batches:
            for k, at, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                entry = sums.setdefault((k, at), [0, 0.0])
                entry[0] += n
                entry[1] = entry[1] + n * np.frombuffer(data, "<f4").astype(np.float64)
        items = list(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in items], pa.int32()), pa.array([a for (_, a), _ in items], pa.int32()), pa.array([e[0] for _, e in items], pa.int64()),
                                          pa.array([(e[1] / e[0]).astype("<f4").tobytes() for _, e in items], pa.binary())], names=["array", "at", "tokens", "rows"])

    schema = "array int, at int, tokens long, rows binary"
    learnt = rows.where(~F.col("held")).select("text").mapInArrow(run, schema).repartition(16, "array", "at").mapInArrow(mean, schema).collect()
    arrays = [a.copy() for a in begin.arrays()]
    for r in learnt:
        part = np.frombuffer(r["rows"], "<f4").reshape(-1, arrays[r["array"]].shape[1])
        arrays[r["array"]][r["at"]:r["at"] + len(part)] = part
    return lbl.Parameters.of(arrays)


@functools.lru_cache(maxsize=1)
def _scorer(mark: str, data: tuple[bytes, ...], settings: lbl.Settings) -> lbl.Scorer:
    n, d = settings.classes, settings.dim
    shapes = [(n + 1, d), (n + 1, d), (n, d), (n, 1)]
    return lbl.Scorer(lbl.Parameters.of([np.frombuffer(x, np.float32).reshape(s) for x, s in zip(data, shapes)]))


def score(df: DataFrame, held_out: Column, text: str = "text", keep: list[str] | None = None, settings: lbl.Settings = lbl.Settings()) -> DataFrame:
    """``row`` (struct of the kept columns), held_out, n_tokens, n_known, train_tokens, base_score and score, all scores log10."""
    spark = df.sparkSession
    runtime.ship(spark)
    buckets = sk.bucket_count(spark)
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"), held_out.alias("held"), F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"))
    counted = runtime.materialize(count_words(rows, settings, buckets), "word-counts")
    groups = counted.where("kind = 3").groupBy("key").agg(F.sum("count").alias("count"), F.sum("distinct").alias("distinct")).collect()
    vocabulary = Vocabulary(*most_frequent(counted, settings.words), {r["key"]: (r["count"], r["distinct"]) for r in groups}, settings)
    parameters = tuple(np.ascontiguousarray(a, np.float32).tobytes() for a in train(rows, vocabulary).arrays())
    model = spark.sparkContext.broadcast((hashlib.sha256(b"".join(parameters)).hexdigest(), parameters, vocabulary))  # bounded by the number of classes
    row_type = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType()),
                           T.StructField("text", T.StringType()), T.StructField("held", T.BooleanType()), T.StructField("row", row_type)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in tb.blocks(batches, 0):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([2] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.binary()), *part.columns], names=schema.fieldNames())

    texts = rows.mapInArrow(numbered, schema)
    counts = counted.where("kind = 1").select("block", "kind", "bucket", "payload", F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("held"), F.lit(None).cast(row_type).alias("row"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = tb.dealt(texts.unionByName(counts), 2 * parts).sortWithinPartitions("block", "kind", "bucket")
    result = T.StructType([T.StructField("row", row_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("lm", _scorer.cache_clear)
        mark, data, voc = model.value
        scorer, s = _scorer(mark, data, settings), settings
        lots, texts, now = [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if not texts:
                return
            table = pa.Table.from_batches(texts)
            keys, row, n = tokens(tb.column(table, "text"), s.groups)
            words, place = np.unique(keys, return_inverse=True)
            if sum(map(len, lots)) != len(words):
                raise RuntimeError("the texts came in another order than when they were counted; write them to a table first")
            count = np.concatenate(lots)[place]
            log = np.log10(count + 1.0)
            classes = voc.classes(keys)
            own = classes < s.words
            rest = voc.rest[np.maximum(classes - s.words, 0)].sum(axis=1) + 1
            model_log = scorer(*lbl.contexts(classes, row, s.classes), classes) + np.where(own, 0.0, log - np.log10(rest))
            total = np.bincount(row, minlength=n)
            base = np.bincount(row, weights=log, minlength=n) - total * np.log10(float(voc.n + voc.v + 1))
            yield pa.RecordBatch.from_arrays([tb.column(table, "row"), tb.column(table, "held"), pa.array(total), pa.array(np.bincount(row, weights=count > 0, minlength=n).astype(np.int64)),
                                              pa.array(np.full(n, voc.n, np.int64)), pa.array(base), pa.array(np.bincount(row, weights=model_log, minlength=n))], names=result.fieldNames())

        for batch in batches:
            ids, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
                if a == b:
                    continue
                if ids[a] != now:
                    yield from flush()
                    lots, texts, now = [], [], ids[a]
                if kinds[a] == 1:
                    lots += [sk.unplanes(x, U64, len(x) // 8).astype(np.int64) for x in batch.column(3).slice(a, b - a).to_pylist()]
                else:
                    texts.append(batch.slice(a, b - a).select(["text", "held", "row"]))
        yield from flush()

    return met.mapInArrow(run, result)
