"""Nearest neighbours by inner product with cross-polytope hashing.

Vectors of about one length (a band of a segment) are lifted by one coordinate
to the longest of them, so that the largest inner product becomes the smallest
angle.  A table turns them by three rounds of random signs and a fast Hadamard
transform, and files each under the signed axis it is nearest to; a query looks
under its ``probes`` nearest signed axes in every table.  The inner product of
the k-th best row found there tells from which angle on a row of a band can
still be among the best, and how many axes a row at that angle needs to be met
with the chance ``sure``.  The query doubles its axes until it has looked under
so many; under all of them if it finds fewer than k rows.  Only the rows filed
there are multiplied with it, and ranked by the exact inner product.

The index is cut into segments of about ``segment_rows`` rows by a hash of the
id, each with its own tables over the same rotations, and queries visit every
segment in blocks of ``block_rows``.  So no task holds more than one segment
and one block, however many rows share a bucket.

Vectors that are null, zero, or hold null or non-finite numbers take no part,
nor do rows without id; shorter vectors are filled with zeros.  Of rows that
repeat an id the least vector stands.  Equal scores go to the smaller id.
Repeated vectors are rows of their own.  An empty table, or one without a
vector that takes part, has no result.  Only the two columns named are read,
so further columns, whatever their names, have no part in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from votemill import runtime


@dataclass(frozen=True)
class Settings:
    tables: int = 8
    #: axes that a query looks under first
    probes: int = 4
    #: ratio of the longest to the shortest vector of a band, at most
    band: float = 1.1
    #: chance to meet a row that can just reach the k-th best found so far
    sure: float = 0.97
    segment_rows: int = 8_192
    block_rows: int = 512
    seed: int = 11


#: Steps of the cosine for which the axes needed are sampled, and pairs of vectors for each.
STEPS, PAIRS = 20, 300


class Rotations:
    """The random signs of every table, the same in every task, and how many axes a query needs at an angle."""

    def __init__(self, dim: int, settings: Settings):
        self.width = 1 << max(1, math.ceil(math.log2(dim + 1)))
        rng = np.random.default_rng(settings.seed)
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (settings.tables, 3, self.width))
        needed = [self._needed(cosine, dim, settings, rng) for cosine in np.linspace(0, 1, STEPS + 1)]
        self.needed = np.maximum.accumulate(np.array(needed[::-1], np.int32))[::-1]

    def _needed(self, cosine: float, dim: int, settings: Settings, rng: np.random.Generator) -> int:
        """Under how many axes a query has to look to meet, with the chance ``sure``, a row at this angle in one of the tables."""
        queries, others = rng.normal(size=(2, PAIRS, dim + 1))
        queries[:, dim] = 0
        queries /= np.linalg.norm(queries, axis=1, keepdims=True)
        others -= (others * queries).sum(axis=1, keepdims=True) * queries
        others *= math.sqrt(1 - cosine * cosine) / np.linalg.norm(others, axis=1, keepdims=True)
        others += cosine * queries
        least = np.full(PAIRS, 2 * self.width)
        for t in range(settings.tables):
            x, bucket = self.turn(queries, t), self.bucket(others, t)
            at = (np.where(bucket < self.width, 1, -1) * x[np.arange(PAIRS), bucket % self.width])[:, None]
            least = np.minimum(least, (x > at).sum(axis=1) + (-x > at).sum(axis=1) + 1)
        return math.ceil(np.quantile(least, settings.sure))

    def axes(self, cosine: np.ndarray) -> np.ndarray:
        """How many axes to look under for rows of this cosine or more; all of them where it is not positive."""
        return np.where(cosine > 0, self.needed[(np.clip(cosine, 0, 1) * STEPS).astype(np.int64)], 2 * self.width)

    def turn(self, vectors: np.ndarray, table: int) -> np.ndarray:
        x = np.zeros((len(vectors), self.width), np.float32)
        x[:, :vectors.shape[1]] = vectors
        for signs in self.signs[table]:
            x *= signs
            half = 1
            while half < self.width:
                pairs = x.reshape(len(x), -1, 2, half)
                x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
                half *= 2
            x /= math.sqrt(self.width)
        return x

    def bucket(self, vectors: np.ndarray, table: int) -> np.ndarray:
        x = self.turn(vectors, table)
        axis = np.abs(x).argmax(axis=1)
        return axis + self.width * (x[np.arange(len(x)), axis] < 0)

    def order(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The signed axes of a table, nearest first, for each vector."""
        x = self.turn(vectors, table)
        return np.argsort(-np.concatenate([x, -x], axis=1), axis=1, kind="stable")


def lengths(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1)
    return top * np.linalg.norm(vectors / top[:, None], axis=1)


def lift(vectors: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Each vector with the coordinate that brings it to its ``longest``, divided by that."""
    short = vectors / longest[:, None]
    rest = np.sqrt(np.maximum(0.0, 1 - (short * short).sum(axis=1)))
    return np.concatenate([short, rest[:, None]], axis=1)


class Segment:
    """Rows filed by band and signed axis in every table; ``products`` counts the rows that met a query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotations: Rotations, settings: Settings):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.products = ids[order], vectors[order], 0
        own = lengths(self.vectors)
        _, band = np.unique(np.floor(np.log(own) / math.log(settings.band)), return_inverse=True)
        self.longest = np.zeros(band.max() + 1)
        np.maximum.at(self.longest, band, own)
        lifted = lift(self.vectors, self.longest[band])
        axes = 2 * rotations.width
        files = [np.argsort(place, kind="stable") for place in self._places(lifted, band, rotations, settings)]
        sizes = [np.bincount(place, minlength=axes * len(self.longest)) for place in self._places(lifted, band, rotations, settings)]
        self.filed = np.concatenate(files)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.rotations, self.settings = rotations, settings

    @staticmethod
    def _places(lifted: np.ndarray, band: np.ndarray, rotations: Rotations, settings: Settings) -> Iterator[np.ndarray]:
        for t in range(settings.tables):
            yield 2 * rotations.width * band + rotations.bucket(lifted, t)

    def _under(self, order: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
        """The rows (some of them repeated) that lie under the axes ``since`` to ``until`` of their band, in any table."""
        axes, bands = 2 * self.rotations.width, len(self.longest)
        many = until - since
        band = np.repeat(np.arange(bands), many)
        nth = np.arange(len(band)) - np.repeat(np.cumsum(many) - many, many) + since[band]
        place = (axes * (bands * np.arange(len(order))[:, None] + band) + order[:, nth]).ravel()
        first, size = self.starts[place], self.starts[place + 1] - self.starts[place]
        return self.filed[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the ``k`` best candidates of each query."""
        own = lengths(queries)
        flat = np.concatenate([queries / own[:, None], np.zeros((len(queries), 1))], axis=1)
        orders = np.stack([self.rotations.order(flat, t) for t in range(self.settings.tables)], axis=1)
        axes, scores = 2 * self.rotations.width, np.empty(len(self.ids))
        for query, vector, length, order in zip(q_ids.tolist(), queries, own, orders):
            met = self.ids == query
            scores.fill(-np.inf)
            since = np.zeros(len(self.longest), np.int64)
            until = np.full(len(self.longest), min(self.settings.probes, axes))
            while True:
                new = np.zeros(len(met), bool)
                new[self._under(order, since, until)] = True
                at = np.flatnonzero(new & ~met)
                scores[at] = self.vectors[at] @ vector
                met[at] = True
                self.products += len(at)
                floor = -np.partition(-scores, k - 1)[k - 1] if len(scores) >= k else -np.inf
                since, asked = until, self.rotations.axes(floor / length / self.longest)
                if (since >= asked).all():
                    break
                until = np.maximum(since, np.minimum(asked, 2 * since))
            # products are rounded in any order: take all that may tie, then score them one like the other
            at = np.flatnonzero(scores >= floor - 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else scores > -np.inf)
            exact = (self.vectors[at] * vector).sum(axis=1)
            best = np.lexsort((self.ids[at], -exact))[:k]
            yield query, self.ids[at][best], exact[best]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col("vector")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows by ``part``, one part to a task where there are few: by hash some tasks would get several and others none."""
    tasks = min(parts, 4096)
    return df.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))


def _blocks(rows: DataFrame, kind: int, parts: int, dim: int, most: int) -> DataFrame:
    """(part, kind, block, ids, vectors): the rows of a part as one binary row for every ``most`` of them."""
    dealt = _dealt(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), parts).sortWithinPartitions("part", "id")
    schema = "part long, kind int, block long, ids binary, vectors binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, ids, vectors = None, 0, [], []

        def flush():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int64()),
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "vectors": pa.array([np.stack(vectors).tobytes()], pa.binary())})

        for batch in batches:
            for p, i, v in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1)):
                if ids and (p != part or len(ids) >= most):
                    yield flush()
                    block, ids, vectors = (block + 1 if p == part else 0), [], []
                part = p
                own = np.zeros(dim)
                own[:len(v)] = v.values.to_numpy()
                ids.append(i)
                vectors.append(own)
        if ids:
            yield flush()

    return dealt.mapInArrow(run, schema)


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """The ``k`` best candidates found for each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``id``; candidates are all rows but the query's own.
    """
    runtime.ship(df.sparkSession)
    rows = runtime.materialize(usable(df, key, vector), "vectors")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return df.sparkSession.createDataFrame([], result)
    parts, rotations = -(-n // settings.segment_rows), Rotations(dim, settings)
    index = _blocks(rows, 0, parts, dim, 2 * settings.segment_rows)
    # a block of queries is told by its own hash part; it goes to every segment
    asked = rows.where(is_query)
    q_parts = max(1, -(-n // (16 * settings.block_rows)))
    blocks = _blocks(asked, 1, q_parts, dim, settings.block_rows)
    visits = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "kind",
                           (F.col("part") * F.lit(1 << 20) + F.col("block")).alias("block"), "ids", "vectors")
    met = _dealt(index.unionByName(visits), parts).sortWithinPartitions("part", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segments = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                own_part, kind = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                ids = np.frombuffer(batch.column(3)[row].as_py(), np.int64)
                vectors = np.frombuffer(batch.column(4)[row].as_py(), np.float64).reshape(len(ids), dim)
                if own_part != part:
                    part, segments = own_part, []
                if kind == 0:
                    segments.append(Segment(ids, vectors, rotations, settings))
                    continue
                for segment in segments:
                    found = list(segment.search(ids, vectors, k))
                    yield pa.RecordBatch.from_pydict({
                        "query_id": pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64)),
                        "vec_id": pa.array(np.concatenate([i for _, i, _ in found])), "score": pa.array(np.concatenate([s for _, _, s in found]))})

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    # each task passes on k rows a query at most
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
