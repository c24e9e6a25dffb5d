"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

A text is the set of its distinct shingles.  Shingles are ordered by the
number of texts that hold them, rarest first.  Two sets whose similarity
reaches the threshold share at least ``l`` shingles within their first
``n - ceil(t n) + l`` ones, for every ``l``; a longer prefix therefore allows
asking for more shared shingles before a pair is verified.  Each text chooses
its ``l`` by estimated cost: the postings its prefix touches, and the pairs
that can have ``l`` of them in common, each of which costs a verification.  A
pair has to share as many prefix shingles as the smaller ``l`` of the two.

Texts with equal sets are one class, compared once.  Shingles that only one
text holds are never shipped beyond the count: they come first in every prefix
and cannot be shared.  Verification intersects the remaining shingles and uses
the full set sizes, which gives the exact similarity.

Links are returned as components.  Before pairs are listed, every text is held
against a random leader or two among those it shares prefix shingles with, and
the texts so linked are merged; then pairs are listed only across components, all
of them.  A family of near copies thus costs a verification or two a member
rather than one a pair, and no link between components is lost.

Null and empty texts have the empty set and no links; a text with fewer words
than a shingle is one shingle of all its words.  Equal texts are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from votemill import runtime
from votemill.runtime import global_rank
from votemill.llm import caches, components, shared_keys as sk, textblocks as tb


@dataclass(frozen=True)
class Settings:
    width: int = 5
    #: similarity of a link, in hundredths
    percent: int = 75
    #: largest number of shared prefix shingles asked for
    most: int = 24
    #: cost of verifying a pair, in postings touched
    verify: int = 40
    #: leaders drawn for each shingle before pairs are listed
    leaders: int = 2
    #: a shingle that more texts hold is heavy: its texts are compared block by block, not listed pair by pair
    light: int = 32
    #: texts of a block
    block: int = 512


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of ``n`` has to share with any set it is linked with."""
    return -(-n * percent // 100)


def _sets(df: DataFrame, text: str, keep: list[str], settings: Settings, buckets: int) -> DataFrame:
    """Packed rows: kind 0 a text (row, idx, n, set hashes), kind 1 its block's shingles by bucket, kind 2 the block's set sizes."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    row_type = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType()),
                           T.StructField("row", row_type), T.StructField("idx", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())])
    names = schema.fieldNames()

    def lower(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, buf, off in tb.text_blocks(column):
            yield tb.distinct_per_row(*tb.shingles(tb.LOWER[buf], off, settings.width)), len(off) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("join")
        block, codes, owner, texts, keys = TaskContext.get().partitionId() << 20, [], [], 0, 0

        def flush(row_arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
            code, row = np.concatenate(codes), np.concatenate(owner)
            codes.clear()
            owner.clear()
            n = np.bincount(row, minlength=texts)
            packed = sk.packed_rows(block, code, row, buckets)
            sizes = pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([block % buckets], pa.int32()), pa.array([block], pa.int64()), pa.array([sk.pack(n)], pa.binary())], names=names[:4])
            for part in (packed, sizes):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, row_arrow), *[pa.nulls(part.num_rows, pa.int64())] * 4], names=names)

        row_arrow = None
        for batch in batches:
            for at in range(0, batch.num_rows, tb.SLICE_ROWS):
                part = batch.slice(at, tb.SLICE_ROWS)
                row_arrow, n, s1, s2, low = part.column(0).type, [], [], [], texts
                for (code, row), rows_here in lower(part.column(1)):
                    size = np.bincount(row, minlength=rows_here)
                    edge = np.concatenate([[0], np.cumsum(size)])
                    total = [np.concatenate([[0], np.cumsum(tb.mix(code ^ np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64) for salt in (0x5BD1E995, 0x1B873593)]
                    n.append(size)
                    s1.append((total[0][edge[1:]] - total[0][edge[:-1]]).view(np.int64))
                    s2.append((total[1][edge[1:]] - total[1][edge[:-1]]).view(np.int64))
                    codes.append(code)
                    owner.append(row + texts)
                    texts, keys = texts + rows_here, keys + len(code)
                k = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array((block + np.arange(low, low + k)) % buckets, pa.int32()), pa.array([block] * k, pa.int64()), pa.nulls(k, pa.binary()),
                                                  part.column(0), pa.array(np.arange(low, low + k)), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (n, s1, s2)]], names=names)
                if keys >= sk.BLOCK_KEYS or texts + tb.SLICE_ROWS > sk.BLOCK_ROWS:
                    yield from flush(row_arrow)
                    block, codes, owner, texts, keys = block + 1, [], [], 0, 0
        if texts:
            yield from flush(row_arrow)

    return sk.find_repeated(rows.mapInArrow(run, schema), buckets)


def _uid():
    return F.col("block") * F.lit(1 << 15) + F.col("idx")


def _candidates(table: DataFrame, copies: DataFrame, settings: Settings) -> DataFrame:
    """(uid, n, tokens, counts): class representatives that share enough shingles with anyone; rarest first, 64- and 32-bit numbers."""
    blobs = table.where("kind in (1, 2)").select("block", "kind", "bucket", "payload", F.lit(None).cast("long").alias("idx"))
    dropped = copies.select("block", F.lit(3).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("payload"), "idx")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = blobs.unionByName(dropped).repartition(parts, "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, sizes, gone = None, [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows, tokens, counts = (np.concatenate([h[k] for h in held]) for k in range(3))
            enough = np.bincount(rows, minlength=len(sizes)) >= np.maximum(1, least_overlap(sizes.astype(np.int64), settings.percent))
            enough[gone] = False
            kept = enough[rows]
            rows, tokens, counts = rows[kept], tokens[kept], counts[kept]
            order = np.lexsort((tokens, counts, rows))
            rows, tokens, counts = rows[order], tokens[order], counts[order]
            own = np.flatnonzero(enough)
            edge = np.searchsorted(rows, np.append(own, len(sizes)))
            for low in range(0, len(own), 256):
                lot = range(low, min(low + 256, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array((block << 15) + own[low:low + 256]), pa.array(sizes[own[low:low + 256]].astype(np.int64)),
                                                  pa.array([tokens[edge[i]:edge[i + 1]].tobytes() for i in lot], pa.binary()),
                                                  pa.array([counts[edge[i]:edge[i + 1]].tobytes() for i in lot], pa.binary())], names=["uid", "n", "tokens", "counts"])

        for batch in batches:
            for own_block, kind, bucket, payload, idx in zip(*[c.to_pylist() for c in batch.columns]):
                if own_block != block:
                    yield from flush()
                    block, held, sizes, gone = own_block, [], None, []
                if kind == 1:
                    steps, prints, counts = sk.unpack(payload, 3)
                    held.append((np.cumsum(steps.astype(np.int64)), (np.int64(bucket) << 32 | prints.astype(np.int64)), counts))
                elif kind == 2:
                    sizes, = sk.unpack(payload, 1)
                else:
                    gone.append(idx)
        yield from flush()

    return met.mapInArrow(run, "uid long, n long, tokens binary, counts binary")


def choose(n: int, counts: np.ndarray, settings: Settings) -> tuple[int, int]:
    """(l, prefix shingles that others may hold) of least estimated cost for a set of ``n`` of which ``counts`` are shared."""
    overlap = -(-n * settings.percent // 100)
    alone = n - len(counts)  # they come first in the order and take up the prefix
    l = np.arange(1, min(settings.most, overlap) + 1)
    taken = np.minimum(np.maximum(n - overlap + l - alone, 0), len(counts))
    postings = np.concatenate([[0], np.cumsum(counts.astype(np.float64) - 1)])[taken]
    best = int(np.argmin(postings * (1 + settings.verify / l)))
    return int(l[best]), int(taken[best])


def _prefixes(sets: DataFrame, settings: Settings) -> DataFrame:
    """(token, uid, l, n): the prefix shingles of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, sizes, lengths, tokens, ls = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [], [], []
            for r in range(batch.num_rows):
                l, taken = choose(int(sizes[r]), np.frombuffer(batch.column(3)[r].as_py(), np.uint32), settings)
                tokens.append(np.frombuffer(batch.column(2)[r].as_py(), np.int64)[:taken])
                lengths.append(taken)
                ls.append(l)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(uids, lengths)), pa.array(np.repeat(ls, lengths).astype(np.int32)), pa.array(np.repeat(sizes, lengths).astype(np.int32))],
                                                 names=["token", "uid", "l", "n"])

    return sets.select("uid", "n", "tokens", "counts").mapInArrow(run, "token long, uid long, l int, n int")


def _verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    left = sets.select(F.col("uid").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("uid").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for r in range(batch.num_rows):
                n_a, n_b = batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
                one, two = (np.frombuffer(batch.column(k)[r].as_py(), np.int64) for k in (4, 5))
                both = len(one) + len(two) - len(np.unique(np.concatenate([one, two])))
                if 100 * both >= settings.percent * (n_a + n_b - both):
                    linked.append(r)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    # few pairs are left: an exchange of them is a file or two, else each task writes one of its own
    return met.mapInArrow(run, "a long, b long").repartition("a", "b")


def _similar_size(settings: Settings):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * settings.percent


def _leader_pairs(prefixes: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): each text with the leader it shares most prefix shingles with, for every drawing of leaders."""
    # an aggregate that shrinks before its exchange, and a join that can be split: no task holds all rows of a shingle
    firsts = prefixes.groupBy("token").agg(*[
        F.min(F.struct(F.xxhash64(F.lit(turn), "uid").alias("order"), "uid", "l", "n")).alias(f"first_{turn}") for turn in range(settings.leaders)],
        F.count(F.lit(1)).alias("holders")).where("holders > 1").drop("holders")
    drawn = prefixes.join(firsts, "token")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.col(f"first_{t}").alias("who")) for t in range(settings.leaders)]))
    met = drawn.select("uid", "l", "n", each.alias("leader")).where("uid <> leader.who.uid")
    keys = [F.col("leader.turn").alias("turn"), F.col("uid").alias("a"), F.col("leader.who.uid").alias("b"), F.col("n").alias("n_a"), F.col("leader.who.n").alias("n_b"), F.least("l", "leader.who.l").alias("need")]
    pairs = met.select(*keys).groupBy("turn", "a", "b", "n_a", "n_b", "need").agg(F.count(F.lit(1)).alias("shared"))
    best = pairs.where((F.col("shared") >= F.col("need")) & _similar_size(settings)).groupBy("turn", "a").agg(F.max(F.struct("shared", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("x"), F.greatest("a", "best.b").alias("y")).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def _open_rows(prefixes: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Prefix rows of shingles that at least two components hold: token, uid, l, n, comp, ``heavy`` where more than ``settings.light`` texts hold it."""
    named = labels.select(F.col("node").alias("uid"), F.col("comp").alias("label"))
    rows = prefixes.join(named, "uid", "left").select("token", "uid", "l", "n", F.coalesce("label", "uid").alias("comp"))
    mixed = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("holders")).where("low < high")
    return rows.join(mixed.select("token", (F.col("holders") > settings.light).alias("heavy")), "token").select("token", "uid", "l", "n", "comp", "heavy")


def _light_pairs(rows: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): all pairs across components that have a light shingle in common and may reach the shared shingles asked for."""
    heavy = rows.where("heavy").groupBy("uid").agg(F.count(F.lit(1)).alias("h"))
    light = rows.where("not heavy").join(heavy, "uid", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    one, two = (light.select("token", *[F.col(c).alias(f"{d}_{x}") for c, d in (("uid", "u"), ("l", "l"), ("n", "n"), ("comp", "c"), ("h", "h"))]) for x in ("a", "b"))
    met = one.join(two, "token").where((F.col("c_a") < F.col("c_b")) & _similar_size(settings))
    first = [F.first(c).alias(c) for c in ("l_a", "l_b", "h_a", "h_b")]
    pairs = met.groupBy(F.col("u_a").alias("a"), F.col("u_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), *first)
    return pairs.where(F.col("shared") + F.least("h_a", "h_b") >= F.least("l_a", "l_b")).select("a", "b")


def _family_links(rows: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): a spanning set of the links between texts of different components that have a heavy shingle in common.

    The texts are laid out so that those with the same leader are neighbours
    and cut into blocks; blocks that hold a heavy shingle in common meet as
    wholes, and a task works out the overlaps of two blocks without a row per
    pair.
    """
    heavy = rows.where("heavy").select("token", "uid", "comp")
    firsts = heavy.groupBy("token").agg(F.min(F.struct(F.xxhash64("uid").alias("order"), "uid")).alias("first")).select("token", F.col("first.uid").alias("leader"))
    votes = heavy.join(firsts, "token").groupBy("uid", "comp", "leader").agg(F.count(F.lit(1)).alias("shared"))
    placed = votes.groupBy("uid", "comp").agg(F.max(F.struct("shared", "leader")).alias("best")).select("uid", "comp", F.col("best.leader").alias("leader"))
    ranked = global_rank(placed.withColumn("all", F.lit(0)), "all", "leader", "uid")
    blocks = runtime.materialize(ranked.select("uid", "comp", F.floor(F.col("rank0") / settings.block).alias("block")), "blocks")
    held = heavy.select("token", "uid").join(blocks.select("uid", "block"), "uid").select("token", "block").distinct()
    pairs = (held.withColumnRenamed("block", "x").join(held.withColumnRenamed("block", "y"), "token").where("x <= y").select("x", "y").distinct())
    pairs = runtime.materialize(pairs, "block-pairs")
    full = blocks.join(sets.select("uid", "n", "tokens"), "uid")
    left = full.join(pairs, full.block == pairs.x).select("x", "y", F.lit(0).alias("side"), "uid", "comp", "n", "tokens")
    right = full.join(pairs.where("x < y"), full.block == pairs.y).select("x", "y", F.lit(1).alias("side"), "uid", "comp", "n", "tokens")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionByName(right).repartition(parts, "x", "y").sortWithinPartitions("x", "y", "side", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:2] != now:
                    if held:
                        yield _links_of_blocks(held, settings)
                    now, held = row[:2], []
                held.append(row[2:])
        if held:
            yield _links_of_blocks(held, settings)

    return met.mapInArrow(run, "a long, b long").repartition("a", "b")


def _links_of_blocks(rows: list[tuple], settings: Settings) -> pa.RecordBatch:
    """Links that join components among the texts of one or two blocks: rows of (side, uid, comp, n, tokens)."""
    side, uid, comp, size = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    sets = [np.frombuffer(r[4], np.int64) for r in rows]
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum([len(t) for t in sets])])
    parent: dict[int, int] = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    second = np.flatnonzero(side == 1)
    alone = not len(second)
    low, high = (0, len(rows)) if alone else (second[0], len(rows))
    mark = np.zeros(len(names), np.int32)
    out = []
    for i in range(len(rows) if alone else low):
        start = i + 1 if alone else low
        if start >= high:
            break
        mark[token[edge[i]:edge[i + 1]]] = 1
        both = np.add.reduceat(mark[token[edge[start]:edge[high]]], edge[start:high] - edge[start])
        mark[token[edge[i]:edge[i + 1]]] = 0
        near = np.flatnonzero((100 * both >= settings.percent * (size[i] + size[start:high] - both)) & (comp[start:high] != comp[i])) + start
        for j in near.tolist():
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                parent[x] = y
                out.append((int(uid[i]), int(uid[j])))
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(sets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(node, comp) over the representatives that have a link."""
    prefixes = runtime.materialize(_prefixes(sets, settings), "prefixes")
    led = runtime.materialize(_verified(_leader_pairs(prefixes, settings), sets, settings), "links")
    rows = runtime.materialize(_open_rows(prefixes, components.connected(led), settings), "open")
    pairs = runtime.materialize(_verified(_light_pairs(rows, settings), sets, settings), "links")
    families = runtime.materialize(_family_links(rows, sets, settings), "links")
    return components.connected(led.union(pairs).union(families))


def join(df: DataFrame, text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``row`` (struct of the kept columns), ``uid``, ``n_shingles`` and ``component``: the uid that stands for all texts reachable by links."""
    spark = df.sparkSession
    runtime.ship(spark)
    runtime.lean(spark)
    buckets = sk.bucket_count(spark)
    table = runtime.materialize(_sets(df, text, keep or df.columns, settings, buckets), "shingles")
    texts = table.where("kind = 0").withColumn("uid", _uid())
    classes = texts.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    copies = runtime.materialize(texts.join(classes, ["s1", "s2", "n"]).where("uid <> rep").select("uid", "rep", "block", "idx"), "copies")
    sets = runtime.materialize(_candidates(table, copies, settings), "sets")
    found = links(sets, settings)
    reps = copies.select(F.col("uid"), "rep")
    return (texts.select("row", "uid", F.col("n").alias("n_shingles")).join(reps, "uid", "left").withColumn("rep", F.coalesce("rep", "uid"))
            .join(found.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("row", "uid", "n_shingles", F.coalesce("comp", "rep").alias("component")))


def with_component_id(joined: DataFrame, key: str) -> DataFrame:
    """Adds ``component_id``, the smallest ``key`` of the component (null keys aside)."""
    least = joined.groupBy("component").agg(F.min(f"row.{key}").alias("component_id"))
    return joined.join(least, "component")
