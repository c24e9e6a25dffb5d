"""Two-dimensional maps of members from votes and from speech embeddings (MLlib)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from votemill import constants as C
from votemill.runtime import global_rank, materialize, ship

#: Hash blocks that centres are packed into.
BLOCKS = 8


def vote_points(vote_record: DataFrame, vote: DataFrame, person: DataFrame, *, years,
                min_votes: int = 100, min_vote_count: int = 20, min_members: int = 5) -> DataFrame | None:
    """Raw coordinates ``(person_id, party, n_votes, x, y, var1, var2)`` from the vote matrix.

    The matrix has one row per vote and one column per member, each row centred
    on its own mean: its right singular vectors times the singular values are the
    member coordinates.  Sizes on the driver depend on the members, never on the votes.
    ``None`` when there are too few votes or members for a map.
    """
    spark = vote.sparkSession
    votes = vote.where(F.col("vp_year").isin(list(years)) & (F.col("is_procedural") == 0)).select("vote_id")
    n_votes = votes.count()
    if n_votes < min_vote_count:
        return None
    value = F.when(F.col("vote_value") == C.YES, 1.0).when(F.col("vote_value") == C.NO, -1.0)
    cells = materialize(
        vote_record.where(F.col("person_id").isNotNull()).join(votes, "vote_id", "left_semi")
        .select("person_id", "vote_id", value.alias("v")).where(F.col("v").isNotNull()), "vote-cells")
    members = cells.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_votes")).where(F.col("n_votes") >= min_votes)
    members = materialize(
        global_rank(members.withColumn("g", F.lit(0)), "g", "person_id", "person_id", rank="col")
        .select("person_id", "n_votes", F.col("col").cast("int").alias("col")), "map-members")
    n = members.count()
    if n < min_members:
        return None
    # a vote with at least one counted value is a row no longer than the member list, then part of a block
    code = 2 * F.col("col") + (F.col("v") < 0).cast("int")
    per_vote = cells.join(members.select("person_id", "col"), "person_id").groupBy("vote_id").agg(F.collect_list(code).alias("codes"))

    values, axes, energy = _member_axes(materialize(vote_blocks(per_vote, n), "vote-blocks"), n)
    s = np.sqrt(np.maximum(values, 0.0))
    xy = np.zeros((n, 2))
    xy[:, : len(s)] = axes * s
    share = [float(a * a / energy) if energy else 0.0 for a in np.pad(s, (0, 2 - len(s)))]
    points = spark.createDataFrame(pd.DataFrame({"col": np.arange(n, dtype=np.int32), "x": xy[:, 0], "y": xy[:, 1]}))
    return (members.join(points, "col")
            .join(person.select("person_id", F.col("party_current").alias("party")), "person_id", "left")
            .select("person_id", F.coalesce("party", F.lit("?")).alias("party"), "n_votes", "x", "y",
                    F.bround(F.lit(100 * share[0]), 0).cast("int").alias("var1"),
                    F.bround(F.lit(100 * share[1]), 0).cast("int").alias("var2")))


#: Entries of the matrix in a block, and bytes of partial products that the driver takes at once without a second stage.
BLOCK_ENTRIES, DIRECT_BYTES = 1 << 19, 160 << 20
BLOCK = "entries long, votes int, codes binary, starts binary, back binary, cols binary, col_starts binary, energy double"


def vote_blocks(per_vote: DataFrame, n: int) -> DataFrame:
    """Votes ``(codes)``, a list of twice the member's column and one more for a no, packed into blocks of bounded size.

    A block holds its entries by vote (``codes``: the column, ``n`` more for a no) and by column
    (``back``: the vote, the number of votes more for a no), each with the place where a vote or column starts,
    and the sum of squares of its centred rows.
    """
    ship(per_vote.sparkSession)

    def packed(values: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        votes, vote = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
        col, no = values >> 1, values & 1
        sums = np.bincount(vote, weights=1.0 - 2.0 * no, minlength=votes)
        energy = float(len(values) - (sums * sums).sum() / n)
        order = np.argsort(vote * n + col, kind="stable")
        vote, col, no = vote[order], col[order], no[order]
        last = np.append((vote[1:] != vote[:-1]) | (col[1:] != col[:-1]), True)  # a member counts once in a vote
        vote, col, no = vote[last], col[last], no[last]
        turned = np.argsort(col, kind="stable")
        cols, col_starts = np.unique(col[turned], return_index=True)
        starts = np.flatnonzero(np.append(True, vote[1:] != vote[:-1]))
        fields = [col + n * no, starts, (vote + votes * no)[turned], cols, col_starts]
        arrays = [[len(col)], [votes], *[[f.astype(np.int32).tobytes()] for f in fields], [energy]]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=[f.split()[0] for f in BLOCK.split(", ")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            lengths, values, at, first = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype(np.int64), 0, 0
            ends = np.cumsum(lengths, dtype=np.int64)
            while at < len(lengths):
                to = max(at + 1, int(np.searchsorted(ends, first + BLOCK_ENTRIES - size, side="right")))
                held.append((values[first:ends[to - 1]], lengths[at:to]))
                size, at, first = size + int(ends[to - 1]) - first, to, int(ends[to - 1])
                if size >= BLOCK_ENTRIES or at < len(lengths):
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    return per_vote.select(F.col("codes").cast("array<int>").alias("codes")).mapInArrow(run, BLOCK)


def _block_times(batch: pa.RecordBatch, at: int, n: int, v: np.ndarray, signed: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Adds Xᵀ(Xv) of one block to ``total`` (a row per vector), but for a constant of each vector, which is returned.

    ``v`` has a row per vector and ``signed`` the same followed by its negative, so an entry is one number looked up.
    The rows of X are centred; where a block is mostly zeros, the means are taken off the sums and no zero is touched.
    """
    entries, votes = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
    codes, starts, back, cols, col_starts = (np.frombuffer(batch.column(k)[at].as_buffer(), np.int32).astype(np.int64) for k in range(2, 7))
    value = np.where(codes < n, 1.0, -1.0)
    if 16 * entries > votes * n:
        vote, step = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, entries))), max(1, (1 << 21) // n)
        for low in range(0, len(starts), step):
            part = slice(*np.searchsorted(vote, [low, low + step]))
            x = np.zeros((min(step, len(starts) - low), n))
            x[vote[part] - low, codes[part] % n] = value[part]
            x -= x.mean(axis=1, keepdims=True)
            total += (x @ v.T).T @ x
        return np.zeros(len(v))
    mean, whole, shift = np.add.reduceat(value, starts) / n, v.sum(axis=1), np.empty(len(v))
    seen = np.zeros(2 * votes)
    for k in range(len(v)):
        y = np.add.reduceat(signed[k].take(codes), starts) - mean * whole[k]
        shift[k] = mean @ y
        seen[:len(y)], seen[votes:votes + len(y)] = y, -y
        total[k, cols] += np.add.reduceat(seen.take(back), col_starts)
    return shift


def _times(rows: DataFrame, n: int, block: np.ndarray) -> np.ndarray:
    """G V for the members' Gram matrix G of the centred rows (see :func:`vote_blocks`) and a few vectors V.

    A task for every core returns sums of length ``n``; where they are too many
    for the driver they are added up lot by lot before they reach it.
    """
    spark = rows.sparkSession
    ship(spark)
    tasks, width, lot = spark.sparkContext.defaultParallelism, block.shape[1], 4096
    handle = spark.sparkContext.broadcast(np.ascontiguousarray(block.T))

    def run(batches):
        v = handle.value
        signed, total, shift = np.concatenate([v, -v], axis=1), np.zeros((width, n)), np.zeros(width)
        for batch in batches:
            for at in range(batch.num_rows):
                shift += _block_times(batch, at, n, v, signed, total)
        total -= shift[:, None]
        starts = list(range(0, n, lot))
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[:, i:i + lot].tobytes() for i in starts], pa.binary())], names=["at", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["at", "sums"])

    parts = rows.coalesce(tasks).mapInArrow(run, "at int, sums binary")
    if tasks * n * width * 8 > DIRECT_BYTES:
        parts = parts.repartition(-(-n // lot), "at").mapInArrow(add, "at int, sums binary")
    out = np.zeros((width, n))
    for r in parts.collect():
        part = np.frombuffer(r["sums"]).reshape(width, -1)
        out[:, r["at"]:r["at"] + part.shape[1]] += part
    handle.destroy()
    return out.T


def _member_axes(rows: DataFrame, n: int, width: int = 8, most: int = 256, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """Two largest eigenvalues of the members' Gram matrix, their vectors, and its trace.

    Block Lanczos iteration with full orthogonalisation and thick restarts: the
    same path for any number of members.  The driver holds ``most`` vectors of
    length ``n`` and some blocks of ``width``; a full basis is restarted from
    its best third.
    """
    energy = rows.agg(F.sum("energy")).first()[0]
    room, small, have = np.empty((n, most)), np.zeros((most, most)), 0
    fresh = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(width, n))))[0]
    while True:
        held, have = have, have + fresh.shape[1]
        room[:, held:have] = fresh
        basis, rest, across = room[:, :have], _times(rows, n, fresh), np.zeros((have, fresh.shape[1]))
        for _ in range(2):
            more = basis.T @ rest
            rest, across = rest - basis @ more, across + more
        small[:have, held:have], small[held:have, :have] = across, across.T
        values, turn = np.linalg.eigh((small[:have, :have] + small[:have, :have].T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        # all that the matrix takes out of the basis is ``rest``, which belongs to the newest block
        q, r = np.linalg.qr(rest)
        left, sizes, right = np.linalg.svd(r)
        new = sizes > 1e-10 * max(values[0], 1e-300)
        far = np.linalg.norm(r @ turn[held:have, :2], axis=0).max()
        if far <= tolerance * max(values[0], 1e-300) or not new.any() or have == n:
            return values[:2], basis @ turn[:, :2], energy
        fresh = q @ left[:, new]
        if have + fresh.shape[1] > most:
            have = most // 3
            room[:, :have] = basis @ turn[:, :have]
            small[:have, :have], basis = np.diag(values[:have]), room[:, :have]
        fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]


def embedding_points(embedding: DataFrame, person: DataFrame, *, dim: int, min_speeches: int = 20,
                     min_members: int = 5) -> DataFrame | None:
    """Raw coordinates from the mean speech embedding of each member: ``(person_id, party, x, y)``.

    ``embedding`` holds ``(person_id, embedding)``, one row per speech.
    """
    mean = mean_embedding(embedding, dim).where(F.col("n") >= min_speeches)
    unit = F.transform("mean", lambda e: e / (F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)) + 1e-9))
    feats = materialize(
        mean.join(person.where(F.col("party_current").isNotNull())
                  .select("person_id", F.col("party_current").alias("party")), "person_id")
        .select("person_id", "party", unit.alias("unit")), "mean-embeddings")
    if feats.count() < min_members:
        return None
    vec = feats.withColumn("vec", array_to_vector("unit"))
    centre = feats.select(*[F.avg(F.col("unit")[i]).alias(f"c{i}") for i in range(dim)]) \
        .select(F.array(*[F.col(f"c{i}") for i in range(dim)])).scalar()
    model = PCA(k=2, inputCol="vec", outputCol="pc").fit(vec)
    pcs = model.pc.toArray()
    centred = F.zip_with("unit", "_c", lambda a, b: a - b)

    def along(k):
        axis = F.array(*[F.lit(float(a)) for a in pcs[:, k]])
        return F.aggregate(F.zip_with("_d", axis, lambda a, b: a * b), F.lit(0.0), lambda acc, p: acc + p)

    return (feats.withColumn("_c", centre).withColumn("_d", centred)
            .select("person_id", "party", along(0).alias("x"), along(1).alias("y")))


def mean_embedding(embedding: DataFrame, dim: int, key: str = "person_id") -> DataFrame:
    """Element-wise mean vector and row count per key; one combined aggregate, no explode."""
    return (embedding.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(dim)])
            .select(key, "n", F.array(*[F.col(f"e{i}") for i in range(dim)]).alias("mean")))


def orient_and_scale(points: DataFrame, left: str = C.MAP_LEFT, right: str = C.MAP_RIGHT,
                     up: str = C.MAP_UP) -> DataFrame:
    """Fixed axis signs by group means, then both axes stretched to [-100, 100]."""
    def mean_of(col, group):
        return F.coalesce(F.avg(F.when(F.col("party") == group, F.col(col))), F.lit(0.0))

    sign = points.agg(
        F.when(mean_of("x", left) > mean_of("x", right), -1.0).otherwise(1.0).alias("sx"),
        F.when(mean_of("y", up) < 0, -1.0).otherwise(1.0).alias("sy"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    frame = sign.select(F.struct("*")).scalar()

    def scaled(col, s, lo, hi):
        flip = F.col("_f")[s] < 0
        low = F.when(flip, -F.col("_f")[hi]).otherwise(F.col("_f")[lo])
        high = F.when(flip, -F.col("_f")[lo]).otherwise(F.col("_f")[hi])
        v = F.col(col) * F.col("_f")[s]
        return F.when(high > low, 200 * (v - low) / (high - low) - 100).otherwise(v)

    return (points.withColumn("_f", frame)
            .withColumn("dim1", scaled("x", "sx", "x0", "x1"))
            .withColumn("dim2", scaled("y", "sy", "y0", "y1")).drop("_f", "x", "y"))


def centroids(points: DataFrame, min_members: int = 3) -> DataFrame:
    return (points.groupBy("party").agg(F.avg("dim1").alias("cx"), F.avg("dim2").alias("cy"),
                                        F.count(F.lit(1)).alias("n_members"))
            .where(F.col("n_members") >= min_members))


def nearest_centroid(points: DataFrame, centres: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds ``nearest_party`` and ``dist_own`` to every point; ties go to the first name.

    Centres are packed into hash blocks; a point meets each block as one row
    and scans it in place, so no row per point and centre is built.
    """
    packed = (centres.groupBy(F.pmod(F.xxhash64("party"), F.lit(blocks)).cast("int").alias("_b"))
              .agg(F.collect_list(F.struct("party", "cx", "cy")).alias("_cs")))
    key = points.columns

    def dist2(c):
        return F.pow(F.col("dim1") - c["cx"], F.lit(2)) + F.pow(F.col("dim2") - c["cy"], F.lit(2))

    best = F.array_min(F.transform("_cs", lambda c: F.struct(dist2(c).alias("d"), c["party"].alias("party"))))
    own = F.get(F.filter("_cs", lambda c: c["party"] == F.col("party")), F.lit(0))
    spread = points.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = spread.join(packed, "_b", "left").select(*key, best.alias("_best"), F.sqrt(dist2(own)).alias("_own"))
    found = met.groupBy(*key).agg(F.min("_best").alias("_best"), F.max("_own").alias("_own"))
    return found.select(*key, F.col("_best.party").alias("nearest_party"), F.col("_own").alias("dist_own"))


def with_centroids(points: DataFrame, person: DataFrame) -> DataFrame:
    """Points with the members' names, and the groups' centres as rows of their own."""
    named = points.join(person.select("person_id", "full_name"), "person_id").select(
        F.lit("member").alias("kind"), "person_id", "full_name", "party", "dim1", "dim2", F.lit(None).cast("long").alias("n_members"))
    middle = centroids(points).select(F.lit("centroid").alias("kind"), F.lit(None).cast("long").alias("person_id"), F.lit(None).cast("string").alias("full_name"),
                                      "party", F.col("cx").alias("dim1"), F.col("cy").alias("dim2"), "n_members")
    return named.unionByName(middle)


def political_map(vote_record: DataFrame, vote: DataFrame, person: DataFrame, *, years=(2023, 2024),
                  left=C.MAP_LEFT, right=C.MAP_RIGHT, up=C.MAP_UP, **limits) -> DataFrame | None:
    """Member positions by how they vote, with centroid distances and explained variance."""
    raw = vote_points(vote_record, vote, person, years=years, **limits)
    if raw is None:
        return None
    period = f"{years[0]}–{years[-1]}"
    pts = orient_and_scale(raw, left, right, up)
    return nearest_centroid(pts, centroids(pts)).withColumn("period", F.lit(period))


def rhetoric_map(embedding: DataFrame, person: DataFrame, *, dim: int, left=C.MAP_LEFT, right=C.MAP_RIGHT,
                 up=C.MAP_UP, **limits) -> DataFrame | None:
    """Member positions by what they talk about."""
    raw = embedding_points(embedding, person, dim=dim, **limits)
    if raw is None:
        return None
    pts = orient_and_scale(raw, left, right, up)
    return nearest_centroid(pts, centroids(pts)).drop("dist_own")
