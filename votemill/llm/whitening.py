"""Whitening of embeddings on the leading principal components, by spectrum slicing.

A number c of a vector becomes the whole number x = floor(64 c) + 1000000.  The
fit list is each distinct vector of such numbers once.  Its sums and its sums of
products around a whole-number centre are added up as whole numbers, so they are
exact whatever the partitions; the covariance V (divisor n) follows from them
without cancellation.

The driver sees only that matrix, whose side is the vectors' dimension.  The
inertia of V - sI from an LDL' factorisation counts the eigenvalues above s;
bisection by such counts isolates each leading eigenvalue, Rayleigh quotient
iteration converges to it and its vector, and two further counts, just below and
just above, certify its number.  Eigenvalues nearer to each other than rounding
are one cluster, whose vectors are made orthogonal one by one.

Left out are vectors that are null or hold null or non-finite numbers, and
nothing else: an empty array or a shorter vector is filled with zeros, repeated
rows each get their results, and a null id stays null.  Components with the
eigenvalue zero (to rounding) have no whitened value and are left out, so a table
of one distinct vector, like an empty table, gives no rows.  Numbers whose x
passes 2^52 in size are held there.  ``deviation`` is null where it passes a
long.  Columns other than the id and the vector are not read, so none clashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from votemill import runtime

SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 2.0 ** 52
#: Share of the largest eigenvalue below which a gap counts as none, and (times the dimension) an eigenvalue as zero.
ROUNDING, ZERO = 1e-13, 1e-12
#: Rows that a task multiplies together.
LOT = 4_096
LONG = (1 << 63) - 1


# the covariance's side only: nothing below this line and above the next grows with the rows

def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``shift``: positive blocks of a pivoted LDL' (Bunch and Kaufman)."""
    a, above, at = matrix - shift * np.eye(len(matrix)), 0, 0
    n, alpha, least = len(a), (1 + 17 ** 0.5) / 8, np.finfo(float).tiny

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while at < n:
        step = 1
        if at + 1 < n:
            column = np.abs(a[at + 1:, at])
            r = at + 1 + int(column.argmax())
            largest = column[r - at - 1]
            if abs(a[at, at]) < alpha * largest:
                beside = np.abs(a[r, at:])
                beside[r - at] = 0
                sigma = beside.max()
                if abs(a[at, at]) * sigma < alpha * largest * largest:
                    if abs(a[r, r]) >= alpha * sigma:
                        swap(at, r)
                    else:
                        step = 2
                        swap(at + 1, r)
        rest = slice(at + step, n)
        if step == 1:
            pivot = a[at, at] if abs(a[at, at]) > least else -least  # an eigenvalue at the shift is not above it
            above += pivot > 0
            column = a[rest, at].copy()
            if column.any():
                a[rest, rest] -= np.outer(column / pivot, column)
        else:
            above += 1  # a block of two is taken only where it is indefinite
            block, columns = a[at:at + 2, at:at + 2], a[rest, at:at + 2].copy()
            a[rest, rest] -= columns @ np.linalg.solve(block, columns.T)
        at += step
    return above


class Spectrum:
    """Leading eigenpairs of a symmetric matrix, largest first."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.side = matrix, len(matrix)
        reach = np.abs(matrix).sum(axis=1)
        self.low, self.high = float((np.diag(matrix) - reach).min()), float(reach.max())
        self.scale = max(self.high, -self.low, np.finfo(float).tiny)
        self.counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.matrix, shift)
        return self.counts[shift]

    def isolate(self, number: int) -> tuple[float, float, bool]:
        """(low, high, alone): the narrowest known interval of eigenvalue ``number`` (from 0), cut until no other one is in it."""
        low, high = self.low - self.scale * 1e-3, self.high + self.scale * 1e-3
        for shift, count in self.counts.items():
            if count > number:
                low = max(low, shift)
            else:
                high = min(high, shift)
        while high - low > ROUNDING * self.scale:
            if self.above(low) == number + 1 and self.above(high) == number:
                return low, high, True
            middle = (low + high) / 2
            if not low < middle < high:
                break
            if self.above(middle) > number:
                low = middle
            else:
                high = middle
        return low, high, False

    def _solve(self, shift: float, vector: np.ndarray) -> np.ndarray:
        for nudge in (0.0, 1e-15, 1e-12):
            try:
                out = np.linalg.solve(self.matrix - (shift + nudge * self.scale) * np.eye(self.side), vector)
            except np.linalg.LinAlgError:
                continue
            length = np.linalg.norm(out)
            if np.isfinite(length) and length > 0:
                return out / length
        return vector

    def _iterate(self, low: float, high: float, found: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration inside (low, high), orthogonal to the vectors found."""

        def clean(v: np.ndarray) -> np.ndarray:
            for _ in range(2):
                v = v - found @ (found.T @ v)
            return v / np.linalg.norm(v)

        vector, shift = clean(rng.normal(size=self.side)), (low + high) / 2
        vector = clean(self._solve(shift, vector))
        best, least = (shift, vector), np.inf
        for _ in range(40):
            value = float(vector @ self.matrix @ vector)
            residual = float(np.linalg.norm(self.matrix @ vector - value * vector))
            if residual < least and low <= value <= high:
                best, least = (value, vector), residual
            elif least < 1e-12 * self.scale:
                break
            # outside of its interval the quotient would lead to another eigenvalue
            vector = clean(self._solve(value if low < value < high else shift, vector))
        return best

    def certified(self, number: int, value: float) -> bool:
        """Whether counts just below and just above ``value`` place it at ``number``."""
        margin = 1e-11 * self.scale
        return self.above(value - margin) > number >= self.above(value + margin)

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, vectors as columns) of up to ``most`` positive eigenvalues."""
        values, vectors, rng = [], np.zeros((self.side, 0)), np.random.default_rng(5)
        for number in range(min(most, self.side)):
            low, high, alone = self.isolate(number)
            if high <= ZERO * self.side * self.scale:
                break
            while True:
                width = high - low
                margin = 0.0 if alone else 1e-10 * self.scale
                value, vector = self._iterate(low - margin, high + margin, vectors, rng)
                if self.certified(number, value) or width <= ROUNDING * self.scale:
                    break
                middle = (low + high) / 2  # the iteration went astray: a narrower interval
                low, high = (middle, high) if self.above(middle) > number else (low, middle)
            if not self.certified(number, value):
                raise ArithmeticError(f"eigenvalue {number + 1} could not be placed")
            if value <= ZERO * self.side * self.scale:
                break
            values.append(value)
            vectors = np.column_stack([vectors, vector])
        return np.array(values), vectors


# rows, in tasks

def _packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): usable rows, their whole numbers as little-endian bytes of 32 bits, or of 64 where one does not fit."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("wide", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            off = column.offsets.to_numpy()
            numbers = np.clip(np.floor(column.values.to_numpy(zero_copy_only=False) * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT
            wide, packed = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                own = numbers[a:b]
                big = bool(len(own)) and (own.max() >= 1 << 31 or own.min() < -(1 << 31))
                wide.append(big)
                packed.append(own.astype("<i8" if big else "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.bool_()), pa.array(packed, pa.binary())], names=["key", "wide", "x"])

    return rows.mapInArrow(run, schema)


def _unpack(wide: pa.Array, x: pa.Array, side: int) -> np.ndarray:
    """Rows of whole numbers, short ones filled with what zero becomes."""
    out = np.full((len(x), side), SHIFT, np.int64)
    for r, (big, data) in enumerate(zip(wide.to_pylist(), x.to_pylist())):
        own = np.frombuffer(data, "<i8" if big else "<i4")
        out[r, :len(own)] = own
    return out


def _summed(fit: DataFrame, shape: tuple[int, ...], fn: Callable[[pa.RecordBatch], np.ndarray], exact: bool) -> np.ndarray:
    """Sum over the fit list of a table of ``shape`` that ``fn`` makes of a lot of rows: a row per cell, added up by Spark.

    ``exact``: whole numbers, added as decimals of 38 digits, each in two halves.
    """
    number = "decimal(38,0)" if exact else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, object if exact else float)
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                total = total + fn(batch.slice(at, LOT))
        cells = total.ravel().tolist()
        kind = pa.decimal128(38, 0) if exact else pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array([int(c) for c in cells] if exact else cells, kind)], names=["cell", "part"])

    cells = fit.select("wide", "x").mapInArrow(run, f"cell long, part {number}").groupBy("cell").agg(F.sum("part").alias("total")).collect()
    out = np.zeros(int(np.prod(shape)), object if exact else float)
    for r in cells:
        out[r.cell] = int(r.total) if exact else r.total
    return out.reshape(shape)


def products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of whole numbers, as Python ints where they may pass a long."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * len(y) < 1 << 53:  # every partial sum is a whole number that a double holds
        small = y.astype(float)
        return (small.T @ small).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(list_: DataFrame, side: int, most: int) -> Fit | None:
    """The model of a written fit list (wide, x); None where nothing varies."""
    n = list_.count()
    if not n or not side:
        return None
    sums = _summed(list_, (side,), lambda b: _unpack(b.column(0), b.column(1), side).astype(object).sum(axis=0), exact=True)
    sums = [int(s) for s in sums]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the nearest whole number: what is left of the mean is at most a half
    left = [s - n * int(c) for s, c in zip(sums, centre)]
    moments = _summed(list_, (side, side), lambda b: products(_unpack(b.column(0), b.column(1), side) - centre), exact=True)
    covariance = np.array([[(n * int(moments[i, j]) - left[i] * left[j]) / (n * n) for j in range(side)] for i in range(side)])
    if not covariance.any():
        return None
    values, vectors = Spectrum(covariance).leading(most)
    mean = np.array(left, float) / n

    def seconds(batch: pa.RecordBatch) -> np.ndarray:
        w = (_unpack(batch.column(0), batch.column(1), side) - centre - mean) @ vectors / np.sqrt(values)
        return w.T @ w

    whitened = _summed(list_, (len(values), len(values)), seconds, exact=False) / n
    error = float(np.abs(whitened - np.eye(len(values))).max())
    return Fit(n, sums, centre, values, vectors, float(np.trace(covariance)), error)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """Per usable row and component: ``key``, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    runtime.ship(spark)
    rows = runtime.materialize(_packed(df, key, vector), "whole-numbers")
    list_ = runtime.materialize(rows.select("wide", "x").distinct(), "fit-list")
    side = list_.agg(F.max(F.octet_length("x") / F.when(F.col("wide"), 8).otherwise(4))).first()[0]
    side = int(side or 0)
    if list_.where(F.octet_length("x") < F.when(F.col("wide"), 8).otherwise(4) * side).take(1):  # short vectors that fill up to another one's numbers
        list_ = runtime.materialize(_filled(list_, side).distinct(), "fit-list")
    model = fit(list_, side, most)
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    if model is None:
        return spark.createDataFrame([], schema)
    names, k = schema.fieldNames(), len(model.values)
    left = [s - model.n * int(c) for s, c in zip(model.sums, model.centre)]
    mean, onto = np.array(left, float) / model.n, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                part = batch.slice(at, LOT)
                y = _unpack(part.column(1), part.column(2), side) - model.centre
                white = ((y - mean) @ onto).ravel()
                far = deviations(y, model.n, left)
                m = part.num_rows
                rows_out = [part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([model.n] * (m * k), pa.int64()),
                            pa.array([d for d in far for _ in range(k)], pa.int64()), pa.array(white), pa.array(np.tile(model.values / model.trace, m)), pa.array([model.identity_error] * (m * k))]
                yield pa.RecordBatch.from_arrays(rows_out, names=names)

    return rows.mapInArrow(run, schema)


def _filled(list_: DataFrame, side: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpack(batch.column(0), batch.column(1), side)
            big = ((x >= 1 << 31) | (x < -(1 << 31))).any(axis=1)
            packed = [row.astype("<i8" if b else "<i4").tobytes() for row, b in zip(x, big)]
            yield pa.RecordBatch.from_arrays([pa.array(big), pa.array(packed, pa.binary())], names=["wide", "x"])

    return list_.mapInArrow(run, "wide boolean, x binary")


def deviations(y: np.ndarray, n: int, left: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for centred rows y, exact; None where it passes a long."""
    most = n * (int(np.abs(y).max()) if y.size else 0) + max(map(abs, left), default=0)
    if most * most * max(1, y.shape[1]) <= LONG:
        far = n * y - np.array(left, np.int64)
        return (far * far).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, left)) for row in y.tolist()]
    return [d if d <= LONG else None for d in exact]
