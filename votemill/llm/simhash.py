"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half the XXH64 hashes of its word
shingles have it (repeats count, words joined by one space).  Fingerprints with
at most ``distance`` differing bits are linked, and links are returned as
components.

The fingerprint is cut into segments.  Two fingerprints of a link differ in at
most ``radius`` bits of some segment, where the radii of m segments add up to
``distance - m + 1``; so each fingerprint enumerates the small Hamming ball
around each of its segments, looks the values up in the tables of segments, and
complete distances are verified inside the lookup.  Of two fingerprints with
different values in a segment the smaller value looks for the larger, which
halves the balls.  The number of segments is chosen by the number of
fingerprints (``plan``); any choice gives the same links.

A value that more than ``light`` fingerprints hold is not looked up pair by
pair.  The fingerprints that hold or look for such a value meet by their whole
fingerprints instead: two are within ``distance`` exactly if the balls of half
that distance around them have a point in common.  A point has a bounded number
of fingerprints around it, so no group grows with a family of near copies.

Null and empty texts and texts without words have the fingerprint zero, linked
like any other; a text with fewer words than a shingle has one shingle of all
its words.  Texts are taken whole, a long one a lot of shingles at a time.
Equal texts and repeated rows have equal fingerprints, which are compared once
and are one component.  An empty table gives no rows.  The kept columns travel
as one struct, so none clashes with a result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from votemill import runtime
from votemill.llm import caches, components, textblocks as tb


@dataclass(frozen=True)
class Settings:
    width: int = 4
    #: even, at most 6 (half of it is the radius of the balls of whole fingerprints)
    distance: int = 4
    seed: int = 42
    light: int = 64
    segments: int | None = None


BITS = 64
#: Shingles whose hashes are counted together, and cost of a verified pair against a lookup.
LOT, PAIR_COST = 1 << 16, 0.3


def fingerprint(text: bytes, settings: Settings = Settings()) -> int:
    """Unsigned fingerprint of one UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    width = min(settings.width, len(words))
    starts, ends = (end - length)[:len(words) - width + 1], end[width - 1:]
    digest, seed, ones = xxhash.xxh64_intdigest, settings.seed, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), LOT):
        spans = zip(starts[at:at + LOT].tolist(), ends[at:at + LOT].tolist())
        hashes = np.array([digest(joined[s:e], seed) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``row`` (struct of the kept columns) and ``fingerprint`` (its 64 bits as a signed long)."""

    def run(column: pa.Array) -> list[pa.Array]:
        caches.enter("simhash")
        found = [fingerprint((t.as_py() or "").encode(), settings) for t in column]
        return [pa.array(np.array(found, np.uint64).view(np.int64))]

    return tb.map_texts(df, text, keep or df.columns, run, [("fingerprint", T.LongType())])


@dataclass(frozen=True)
class Segment:
    shift: int
    width: int
    radius: int


def _cut(segments: int, distance: int) -> list[Segment]:
    """Segments of nearly equal width whose radii add up to ``distance - segments + 1``."""
    spare, edges = distance - segments + 1, [BITS * k // segments for k in range(segments + 1)]
    return [Segment(low, high - low, (spare + segments - 1 - k) // segments) for k, (low, high) in enumerate(zip(edges, edges[1:]))]


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def plan(rows: int, settings: Settings = Settings()) -> list[Segment]:
    """The segments of least estimated cost for so many fingerprints: lookups, and chance meetings to verify."""
    if settings.segments:
        return _cut(settings.segments, settings.distance)

    def cost(segments: list[Segment]) -> float:
        return sum(_ball(s.width, s.radius) * (1 + PAIR_COST * rows / 2.0 ** s.width) for s in segments)

    return min((_cut(m, settings.distance) for m in range(2, settings.distance + 2)), key=cost)


def _flips(width: int, radius: int) -> list[int]:
    """Every mask of up to ``radius`` of ``width`` bits; at most some thousands."""
    masks = level = [0]
    for _ in range(radius):
        level = sorted({m | 1 << b for m in level for b in range(width) if not m >> b & 1})
        masks = masks + level
    return masks


def _slot(number: int, value: Column) -> Column:
    return F.lit(number << 56) + value


def _value(segment: Segment, fingerprint: str) -> Column:
    return F.shiftrightunsigned(fingerprint, segment.shift).bitwiseAND(F.lit((1 << segment.width) - 1))


def _sought(number: int, segment: Segment) -> Column:
    """The slots a fingerprint looks in: the ball around its value, as far as that is not smaller."""
    own = _value(segment, "fp")
    around = F.transform(F.lit(_flips(segment.width, segment.radius)).cast("array<bigint>"), lambda mask: own.bitwiseXOR(mask))
    return F.transform(F.filter(around, lambda value: value >= own), lambda value: _slot(number, value))


def _tables(prints: DataFrame, segments: list[Segment]) -> tuple[DataFrame, DataFrame]:
    """(slot, held) of every fingerprint's segments, and (slot, seeks) of every value it looks for."""
    held = [_slot(k, _value(s, "fp")) for k, s in enumerate(segments)]
    sought = [_sought(k, s) for k, s in enumerate(segments)]
    return (prints.select(F.explode(F.array(*held)).alias("slot"), F.col("fp").alias("held")),
            prints.select(F.explode(F.concat(*sought)).alias("slot"), F.col("fp").alias("seeks")))


def _near(a: str, b: str, settings: Settings) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= settings.distance


def _met(held: DataFrame, sought: DataFrame, segments: list[Segment], settings: Settings) -> DataFrame:
    """(a, b): verified links found in the tables; two of one value are met once."""
    own = F.lit(False)
    for k, s in enumerate(segments):
        own = own | ((F.shiftright("slot", 56) == k) & (_value(s, "seeks") == _value(s, "held")))
    pairs = sought.join(held, "slot").where(_near("seeks", "held", settings) & (~own | (F.col("seeks") < F.col("held"))))
    return pairs.select(F.col("seeks").alias("a"), F.col("held").alias("b"))


def _through_points(crowd: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): links between components among the fingerprints of crowded values, by common points of their balls."""
    radius = settings.distance // 2
    named = crowd.join(labels.select(F.col("node").alias("fp"), F.col("comp").alias("label")), "fp", "left").select("fp", F.coalesce("label", "fp").alias("comp"))
    mask, bits, last = F.lit(0).cast("long"), [], F.lit(0)
    points = named
    for r in range(radius):  # bits in rising order; a bit of 64 stands for none
        points = points.withColumn(f"b{r}", F.explode(F.sequence(last, F.lit(BITS))))
        points = points.where((F.col(f"b{r}") > F.col(f"b{r - 1}")) | (F.col(f"b{r - 1}") == BITS)) if r else points
        last = F.col(f"b{r}")
        bits.append(f"b{r}")
    for b in bits:
        mask = mask.bitwiseOR(F.when(F.col(b) < BITS, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(b))).otherwise(F.lit(0).cast("long")))
    points = points.select(F.col("fp").bitwiseXOR(mask).alias("point"), "comp")
    around = points.groupBy("point").agg(F.collect_set("comp").alias("comps")).where(F.size("comps") > 1)  # at most a ball of them
    pairs = around.select(F.array_min("comps").alias("a"), F.explode("comps").alias("b")).where("a <> b")
    return pairs.distinct()


def links(prints: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(node, comp) over the fingerprints, column ``fp`` and distinct, that have a link."""
    segments = plan(prints.count(), settings)
    held, sought = _tables(prints, segments)
    crowded = runtime.materialize(held.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > settings.light).select("slot"), "crowded")
    some = bool(crowded.take(1))
    light = held.join(crowded, "slot", "left_anti") if some else held
    found = runtime.materialize(_met(light, sought, segments, settings), "links")
    labels = components.connected(found)
    if not some:
        return labels
    crowd = (held.withColumnRenamed("held", "fp").unionByName(sought.withColumnRenamed("seeks", "fp")).join(crowded, "slot", "left_semi").select("fp").distinct())
    across = runtime.materialize(_through_points(runtime.materialize(crowd, "crowd"), labels, settings), "links")
    return components.connected(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(across))


def near_duplicates(df: DataFrame, text: str = "text", keep: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``row`` (struct of the kept columns), ``fingerprint`` and ``component``: a fingerprint that stands for all texts reachable by links."""
    table = runtime.materialize(fingerprints(df, text, keep, settings), "fingerprints")
    prints = runtime.materialize(table.select(F.col("fingerprint").alias("fp")).distinct(), "prints")
    found = links(prints, settings).select(F.col("node").alias("fingerprint"), "comp")
    return table.join(found, "fingerprint", "left").select("row", "fingerprint", F.coalesce("comp", "fingerprint").alias("component"))


def with_component_id(found: DataFrame, key: str) -> DataFrame:
    """Adds ``component_id``, the smallest ``key`` of the component (null keys aside)."""
    least = found.groupBy("component").agg(F.min(f"row.`{key}`").alias("component_id"))
    return found.join(least, "component")
