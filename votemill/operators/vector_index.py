"""Written inverted lists for nearest vectors by cosine: rows filed by the nearest of many centres.

``build`` fits the centres (MLlib) on a bounded sample of unit vectors, files
every row under its nearest centre, one folder per cell, and measures on the
sample under how many cells a query has to look to find the share ``recall`` of
its ``k`` nearest.  Rows are filed as unit vectors.  A search reads the folders of these cells only; scores are
exact.  Where vectors are spread without any clusters, that is most of them.

Vectors that are null, zero, of another length than most, or hold null or
non-finite numbers are left out.  A search that finds fewer than ``k`` rows
looks into all cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from votemill.operators.relational import top_n
from votemill.operators.search import cosine_top_k, unit_vector
from votemill.runtime import materialize, ship


@dataclass(frozen=True)
class Settings:
    #: cells; if not given the root of the number of rows, so that centres and rows of a cell grow alike
    cells: int | None = None
    #: cells at most, as every task holds the centres
    max_cells: int = 4_096
    #: vectors that the centres are fitted on and the cells to look under are measured with, the first by a hash of their id
    fit_rows: int = 32_768
    test_rows: int = 256
    k: int = 30
    recall: float = 0.95
    #: files that the rows of a cell are dealt over, so that a cell of very many alike rows is no single task
    splits: int = 8
    seed: int = 5


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, unit) of the rows that take part; vec is a double array."""
    v = F.col("vec")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return rows.withColumn("unit", unit_vector(v))


def _order(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells by nearness, for each vector."""
    return np.argsort(-(units @ centres.T), axis=1, kind="stable")


def _probes(units: np.ndarray, centres: np.ndarray, s: Settings) -> int:
    """The least number of cells under which the sample's queries find the share ``recall`` of their ``k`` nearest."""
    asked = units[:s.test_rows]
    scores = asked @ units.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf  # a query is not its own neighbour
    best = np.argsort(-scores, axis=1, kind="stable")[:, :min(s.k, len(units) - 1)]
    order = _order(asked, centres)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    own = _order(units, centres)[:, 0]
    needed = np.take_along_axis(place, own[best], axis=1).ravel() + 1
    return int(np.ceil(np.quantile(needed, s.recall))) if needed.size else 1


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.schema("cell int, centre array<double>, probes int").parquet(f"{path}/centres").orderBy("cell").collect()  # at most ``max_cells`` rows
        self.centres = np.array([r["centre"] for r in head], float)
        self.probes = head[0]["probes"] if head else 0

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def cells(self, unit: np.ndarray, probes: int | None = None) -> list[int]:
        """The cells that a query looks under."""
        return _order(unit[None, :], self.centres)[0, :probes or self.probes].tolist()

    def nearest(self, query: DataFrame, k: int = 30, id_col: str = "id") -> DataFrame:
        """The ``k`` best rows found by cosine with the query, a one-row frame with one array column: id, score."""
        if not len(self.centres):
            return self.spark.createDataFrame([], f"`{id_col}` long, score double")
        own = query.select(unit_vector(F.col(query.columns[0]))).first()[0]
        found = self.rows.where(F.col("cell").isin(self.cells(np.array(own, float))))
        if found.count() < k:
            found = self.rows
        return cosine_top_k(found, "id", "vec", query, k).withColumnRenamed("id", id_col)

    def nearest_each(self, queries: DataFrame, id_col: str, vec_col: str, k: int = 30) -> DataFrame:
        """The ``k`` best rows found for each query: query_id, rank, id, score.  All queries that take part meet the cells at once."""
        ship(self.spark)
        centres, probes = self.centres, self.probes
        asked = _usable(queries, id_col, vec_col).select("id", "unit")
        if not len(centres):
            return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    units = np.stack([u.values.to_numpy() for u in part.column(1)])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_order(units, centres)[:, :probes].astype(np.int32).tolist(), pa.list_(pa.int32()))],
                                                     names=["query_id", "unit", "cells"])

        kind, own = asked.schema["id"].dataType.simpleString(), self.rows.schema["id"].dataType.simpleString()
        visits = asked.mapInArrow(run, f"query_id {kind}, unit array<double>, cells array<int>").select("query_id", "unit", F.explode("cells").alias("cell"))
        # a task holds the queries of a cell, a lot at a time, and meets the rows of the cell with them in blocks
        lots = (visits.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(self._query_lots(asked))).alias("lot"))
                .agg(F.collect_list(F.struct("query_id", "unit")).alias("asked")).select("cell", F.col("asked.query_id").alias("queries"), F.col("asked.unit").alias("units")))
        blocks = (self.rows.select("id", "vec", "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(self._row_lots())).alias("lot"))
                  .agg(F.collect_list(F.struct("id", "vec")).alias("held")).select("cell", F.col("held.id").alias("ids"), F.col("held.vec").alias("vecs")))
        met = lots.join(blocks, "cell").select("queries", "units", "ids", "vecs")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(k)
            for batch in batches:
                for at in range(batch.num_rows):
                    yield from best.add(*(batch.column(c)[at].values for c in range(4)))
            yield from best.held_rows()

        scored = met.mapInArrow(score, f"query_id {kind}, id {own}, dot double").select("query_id", "id", F.round("dot", 9).alias("score"))
        return top_n(scored, ["query_id"], [F.desc("score"), F.asc("id")], k).select("query_id", "rank", "id", "score")

    def _query_lots(self, asked: DataFrame) -> int:
        """Lots of at most some 1,024 queries, if all look under the same cells."""
        return max(1, -(-asked.count() // 1024))

    def _row_lots(self) -> int:
        """Lots of at most some 2,048 rows of the fullest cell."""
        return max(1, -(-(self.rows.groupBy("cell").count().agg(F.max("count")).first()[0] or 0) // 2048))


class _Best:
    """The rows of a task that can be among the ``k`` best of their query by the rounded product.

    A matrix product sorts out the others, by the ``k``-th best seen in the task and a margin above its rounding; the
    products of the rows that are left are summed in the order of the vector's numbers, so they do not depend on blocks.
    Queries and rows held are bounded: known bounds are forgotten, and rows handed on, where there are too many.
    """

    def __init__(self, k: int, most_queries: int = 1 << 16, most_rows: int = 1 << 20):
        self.k, self.most_queries, self.most_rows = k, most_queries, most_rows
        self.place: dict = {}
        self.top = np.full((1024, k), -np.inf)
        self.held: list[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]] = []

    def add(self, queries: pa.Array, units: pa.Array, ids: pa.Array, vecs: pa.Array) -> Iterator[pa.RecordBatch]:
        if len(self.place) > self.most_queries:
            yield from self.held_rows()
            self.place, self.top = {}, np.full((1024, self.k), -np.inf)
        own = np.array([self.place.setdefault(q, len(self.place)) for q in queries.to_pylist()], np.int64)
        while len(self.top) < len(self.place):
            self.top = np.concatenate([self.top, np.full_like(self.top, -np.inf)])
        q, x = _matrix(units), _matrix(vecs)
        rough = q @ x.T
        best = np.partition(rough, len(x) - self.k, axis=1)[:, -self.k:] if len(x) > self.k else rough
        merged = np.concatenate([self.top[own], best], axis=1)
        self.top[own] = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k:]
        i, j = np.nonzero(rough >= self.top[own].min(axis=1)[:, None] - 1e-8)
        if len(i):
            dot = np.zeros(len(i))
            for d in range(q.shape[1]):
                dot += x[j, d] * q[i, d]
            self.held.append((own[i], queries.take(pa.array(i)), ids.take(pa.array(j)), dot))
        if sum(len(h[3]) for h in self.held) > self.most_rows:
            self._cut()
            if sum(len(h[3]) for h in self.held) > self.most_rows // 2:
                yield from self.held_rows()

    def _cut(self) -> None:
        least, kept = self.top.min(axis=1) - 1e-8, []
        for own, queries, ids, dot in self.held:
            good = dot >= least[own]
            kept.append((own[good], queries.filter(pa.array(good)), ids.filter(pa.array(good)), dot[good]))
        self.held = [h for h in kept if len(h[3])]

    def held_rows(self) -> Iterator[pa.RecordBatch]:
        self._cut()
        for _, queries, ids, dot in self.held:
            yield pa.RecordBatch.from_arrays([queries, ids, pa.array(dot)], names=["query_id", "id", "dot"])
        self.held = []


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def build(df: DataFrame, id_col: str, vec_col: str, path: str, settings: Settings = Settings()) -> VectorIndex:
    """Files all rows that take part below ``path``."""
    spark, s = df.sparkSession, settings
    ship(spark)
    rows = materialize(_usable(df, id_col, vec_col), "unit-vectors")
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    head = "cell int, centre array<double>, probes int"
    if size is None:
        spark.createDataFrame([], head).write.parquet(f"{path}/centres")
        rows.select("id", "vec", F.lit(0).alias("cell")).write.parquet(f"{path}/rows")
        return VectorIndex(spark, path)
    rows = rows.where(F.size("vec") == size["size"])
    cells = max(1, min(s.max_cells, s.fit_rows // 8, size["count"], s.cells or math.isqrt(size["count"])))
    sample = materialize(rows.orderBy(F.xxhash64("id", F.lit(s.seed)), "id").limit(s.fit_rows).select("unit"), "fit-vectors")
    units = np.array([r["unit"] for r in sample.collect()], float)  # at most ``fit_rows`` vectors
    if cells > 1:
        model = KMeans(k=cells, seed=s.seed, maxIter=10, distanceMeasure="cosine", featuresCol="vec").fit(sample.select(array_to_vector("unit").alias("vec")))
        centres = np.array(model.clusterCenters())
    else:
        centres = units.mean(axis=0, keepdims=True)
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.where(lengths > 0, centres / np.where(lengths > 0, lengths, 1), 0)
    probes = _probes(units, centres, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = np.stack([u.values.to_numpy() for u in part.column(2)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array((own @ centres.T).argmax(axis=1).astype(np.int32))], names=["id", "vec", "cell"])

    filed = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vec array<double>, cell int")
    filed = filed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(s.splits)))
    filed.write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], head).write.parquet(f"{path}/centres")
    return VectorIndex(spark, path)
