"""A text index of written segments: loads add segments, deletions are tombstones, small segments are merged.

A segment holds postings in blocks.  Its texts are laid out in *slots* of about
``block`` texts of similar length, and a block is one term's texts in one slot,
with the largest count and the smallest length among them: enough to bound the
score that any text of the block can get.  Blocks are dealt out by range of
(bucket, term, slot), so a term of every text is spread over as many tasks as
it has share, and a query reads the folders of its terms only, and in their
files the pages of its terms and slots.

The newest complete folder below ``manifest`` says which segments and
tombstones count.  A load writes a segment and a new manifest and reads none of
the older segments; readers go on with the manifest they have.  Texts without
a token count as texts; ids are unique among the live texts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from votemill.functions import text as X
from votemill.runtime import materialize

BLOCK = 512
#: Tokens that one task of a load handles, and segments of about one size that are merged into one.
TASK_TOKENS, FANOUT = 4_000_000, 4
#: Classes of length for each doubling; slots are numbered inside a class.
CLASSES, SLOT_BITS = 4, 24
#: Blocks in one page of a file, so that a few blocks can be read without their neighbours.
PAGE_BLOCKS = 64
MANIFEST = "kind string, number long, path string, docs long, tokens long, buckets int"
POSTINGS = "term string, slot long, n long, hits long, max_tf int, min_length int, ids array<bigint>, tfs array<int>, lengths array<int>, places array<array<int>>, bucket int"
DOCS = "doc_id long, slot long, length int"
HEADER = ("term", "slot", "n", "hits", "max_tf", "min_length")


@dataclass(frozen=True)
class Part:
    """A segment (``kind`` segment) or the tombstones of one deletion (``kind`` dead)."""

    kind: str
    number: int
    path: str
    docs: int
    tokens: int
    buckets: int


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder, files = _folder(spark, f"{path}/manifest")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(_folder(spark, f"{path}/manifest/{n}/_SUCCESS")[0]))


def _bucket(buckets: int, term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """One version of the index below a path."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        known = _versions(spark, path)
        self.version = version if version is not None else known[-1] if known else 0
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{self.version}").collect() if self.version else []  # a row per segment or deletion
        self.parts = [Part(**r.asDict()) for r in rows]

    @property
    def segments(self) -> list[Part]:
        return [p for p in self.parts if p.kind == "segment"]

    @property
    def totals(self) -> tuple[int, float]:
        """Live texts, and tokens per text."""
        sign = {"segment": 1, "dead": -1}
        docs, tokens = (sum(sign[p.kind] * getattr(p, c) for p in self.parts) for c in ("docs", "tokens"))
        return docs, tokens / docs if docs else 0.0

    # --- reading -------------------------------------------------------------
    def _union(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def dead(self) -> DataFrame | None:
        """(doc_id, slot, length) of deleted texts; None without any."""
        paths = [p.path for p in self.parts if p.kind == "dead"]
        return self.spark.read.schema(DOCS).parquet(*paths) if paths else None

    def docs(self) -> DataFrame:
        """(doc_id, slot, length) of the live texts."""
        every = self._union([self.spark.read.schema(DOCS).parquet(f"{p.path}/docs") for p in self.segments], DOCS)
        gone = self.dead()
        return every if gone is None else every.join(gone.select("doc_id", "slot"), ["doc_id", "slot"], "left_anti")

    def blocks(self, terms: list[str] | None = None, slots: list[int] | None = None, segments: Iterable[Part] | None = None) -> DataFrame:
        """Live blocks, of given terms and slots; only their folders and pages are read."""
        frames = []
        for part in self.segments if segments is None else segments:
            rows = self.spark.read.schema(POSTINGS).parquet(f"{part.path}/postings")
            if terms is not None:
                wanted = [_bucket(part.buckets, F.lit(t)) for t in terms]  # folded to constants before folders are chosen
                rows = rows.where(F.col("bucket").isin(*wanted) & F.col("term").isin(terms)) if terms else rows.limit(0)
            if slots is not None:
                rows = rows.where(F.col("slot").isin([s for s in slots if s >> 32 == part.number]))
            frames.append(rows)
        every, gone = self._union(frames, POSTINGS), self.dead()
        if gone is None:
            return every
        # the deleted texts of a slot are one short list; blocks of other slots keep their written figures
        lists = gone.groupBy("slot").agg(F.collect_list("doc_id").alias("gone"))
        met = every.join(lists, "slot", "left")
        zipped = F.filter(F.arrays_zip("ids", "tfs", "lengths", "places"), lambda p: ~F.array_contains("gone", p["ids"]))
        left = met.withColumn("left", F.when(F.col("gone").isNotNull(), zipped))
        clean = F.col("gone").isNull()
        new = {"n": F.size("left").cast("long"), "hits": F.aggregate("left", F.lit(0).cast("long"), lambda a, p: a + p["tfs"]), "max_tf": F.array_max("left.tfs"), "min_length": F.array_min("left.lengths"),
               "ids": F.col("left.ids"), "tfs": F.col("left.tfs"), "lengths": F.col("left.lengths"), "places": F.col("left.places")}
        return left.select("term", "slot", "bucket", *[F.when(clean, F.col(c)).otherwise(x).alias(c) for c, x in new.items()]).where("n > 0")

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf, doc_length, places) of the live texts; places count from 0."""
        return exploded(self.blocks())

    def term_statistics(self) -> DataFrame:
        """Texts and occurrences per term, from the blocks' figures."""
        return self.blocks().groupBy("term").agg(F.sum("n").alias("n_docs"), F.sum("hits").alias("n_hits"))

    # --- writing -------------------------------------------------------------
    def _commit(self, parts: list[Part]) -> Index:
        version = max([self.version, *_versions(self.spark, self.path)]) + 1
        rows = [(p.kind, p.number, p.path, p.docs, p.tokens, p.buckets) for p in parts]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{version}")
        return Index(self.spark, self.path, version)

    def _next(self) -> int:
        return max([0, *[p.number for p in self.parts]]) + 1

    def add(self, docs: DataFrame, id_col: str = "id", text_col: str = "text", merge: bool = True) -> Index:
        """Adds texts whose ids are not in the index; no older segment is read, unless a merge is due."""
        tokens = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), X.search_tokens(F.col(text_col)).alias("tokens")), "tokens")
        sized = tokens.select("doc_id", F.size("tokens").alias("length"), "tokens")
        part = _write_segment(self.path, self._next(), sized.select("doc_id", "length"),
                              lambda slot: sized.select("doc_id", "length", slot, F.posexplode("tokens").alias("place", "term")), per_place=True)
        new = self._commit([*self.parts, part])
        return new.merged() if merge else new

    def delete(self, ids: DataFrame) -> Index:
        """Marks the texts with these ids (first column) as deleted; only the lists of texts are read."""
        path = f"{self.path}/dead-{uuid.uuid4().hex}"
        self.docs().join(ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "slot", "length").write.parquet(path)
        sums = self.spark.read.schema(DOCS).parquet(path).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return self._commit([*self.parts, Part("dead", self._next(), path, sums[0], sums[1], 0)]) if sums[0] else self

    def replace(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Index:
        """Adds texts, in place of those with the same ids."""
        return self.delete(docs.select(id_col)).add(docs, id_col, text_col)

    def merged(self, fanout: int = FANOUT) -> Index:
        """Merges segments of about one size while there are ``fanout`` of them."""
        index = self
        while True:
            tiers: dict[int, list[Part]] = {}
            for p in index.segments:
                tiers.setdefault(int(math.log(max(1, p.docs), fanout)), []).append(p)
            due = next((ps for _, ps in sorted(tiers.items()) if len(ps) >= fanout), None)
            if due is None:
                return index
            index = index._merge(due)

    def compacted(self) -> Index:
        """One segment without tombstones, and nothing else in the folder."""
        index = self._merge(self.segments) if len(self.segments) > 1 or len(self.parts) > len(self.segments) else self
        index.vacuum()
        return index

    def _merge(self, segments: list[Part]) -> Index:
        numbers = [p.number for p in segments]
        own = F.shiftright("slot", 32).isin(numbers)
        rows = exploded(self.blocks(segments=segments))
        part = _write_segment(self.path, self._next(), self.docs().where(own).select("doc_id", "length"),
                              lambda slot: rows.select("doc_id", F.col("doc_length").alias("length"), F.col("term"), "tf", "places").select("*", slot), per_place=False)
        kept, gone = [p for p in self.parts if p.kind == "segment" and p.number not in numbers], self.dead()
        if gone is not None:  # tombstones of the segments that stay
            path = f"{self.path}/dead-{uuid.uuid4().hex}"
            gone.where(~own).write.parquet(path)
            sums = self.spark.read.schema(DOCS).parquet(path).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
            if sums[0]:
                kept.append(Part("dead", self._next() + 1, path, sums[0], sums[1], 0))
        return self._commit([*kept, part])

    def vacuum(self) -> None:
        """Deletes what this version does not use; older versions can no longer be read then."""
        folder, files = _folder(self.spark, self.path)
        used = {p.path.rsplit("/", 1)[1] for p in self.parts}
        for status in files.listStatus(folder):
            if status.getPath().getName() not in used | {"manifest"}:
                files.delete(status.getPath(), True)
        for version in _versions(self.spark, self.path):
            if version < self.version:
                files.delete(_folder(self.spark, f"{self.path}/manifest/{version}")[0], True)


def exploded(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("term", "slot", F.explode(F.arrays_zip("ids", "tfs", "lengths", "places")).alias("p"))
    return rows.select("term", "slot", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("doc_length"), F.col("p.places").alias("places"))


def _write_segment(base: str, number: int, docs: DataFrame, rows, per_place: bool) -> Part:
    """Writes the texts (doc_id, length) and, from ``rows`` of a slot column, their blocks."""
    spark, path = docs.sparkSession, f"{base}/segment-{number}-{uuid.uuid4().hex[:8]}"
    grade = F.floor(F.log2(F.col("length") + 1) * CLASSES)
    # a row per class of length: at most some hundred
    sizes = {r.grade: (r.n, r.tokens) for r in docs.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).collect()}
    n_docs, n_tokens = sum(n for n, _ in sizes.values()), sum(t for _, t in sizes.values())
    if sizes:
        slots = F.element_at(F.create_map(*[F.lit(x).cast("long") for g, (n, _) in sizes.items() for x in (g, -(-n // BLOCK))]), grade)
    else:
        slots = F.lit(1)
    slot = (F.lit(number << 32) + grade * (1 << SLOT_BITS) + F.pmod(F.xxhash64("doc_id"), slots)).alias("slot")
    docs.select("doc_id", slot, "length").write.parquet(f"{path}/docs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // TASK_TOKENS))
    buckets = max(1, min(4096, parts))
    # ranges cut a term that many texts hold, never a block; all aggregates below stay in their range
    dealt = rows(slot).withColumn("bucket", _bucket(buckets, F.col("term"))).repartitionByRange(parts, "bucket", "term", "slot")
    key = ["bucket", "term", "slot"]
    if per_place:
        dealt = dealt.groupBy(*key, "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("length").alias("length"), F.sort_array(F.collect_list("place")).alias("places"))
    text = F.struct(F.col("doc_id").alias("ids"), F.col("tf").cast("int").alias("tfs"), F.col("length").alias("lengths"), "places")
    blocks = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("hits"), F.max("tf").cast("int").alias("max_tf"), F.min("length").alias("min_length"), F.sort_array(F.collect_list(text)).alias("p"))
    out = blocks.select("term", "slot", "n", "hits", "max_tf", "min_length", *[F.col(f"p.{c}").alias(c) for c in ("ids", "tfs", "lengths", "places")], "bucket")
    (out.sortWithinPartitions(*key).write.option("parquet.page.row.count.limit", str(PAGE_BLOCKS)).option("parquet.page.size.row.check.min", str(PAGE_BLOCKS)).option("parquet.block.size", str(8 << 20)).partitionBy("bucket").parquet(f"{path}/postings"))
    return Part("segment", number, path, n_docs, n_tokens, buckets)


def build(docs: DataFrame, id_col: str, text_col: str, path: str) -> Index:
    """An index of these texts alone below ``path``; readers of an older one there go on until it is vacuumed."""
    old = Index(docs.sparkSession, path)
    empty = Index.__new__(Index)
    empty.spark, empty.path, empty.version, empty.parts = old.spark, path, old.version, []
    new = empty.add(docs, id_col, text_col, merge=False)
    if old.version:
        new.vacuum()
    return new


# --- scoring -----------------------------------------------------------------
@dataclass(frozen=True)
class Weights:
    k1: float
    b: float
    idf_floor: float


def _clean(phrases: list[list[str]]) -> list[list[str]]:
    return [list(p) for p in dict.fromkeys(map(tuple, phrases)) if p]


def _runs(index: Index, phrases: list[list[str]]) -> DataFrame | None:
    """Written (phrase, slot, doc_id, doc_length, tf) of the phrases of several terms: places where all their terms stand in order."""
    several = [(n, p) for n, p in enumerate(phrases) if len(p) > 1]
    if not several:
        return None
    rows = exploded(index.blocks(sorted({t for _, p in several for t in p})))
    asked = F.array(*[F.struct(F.lit(n).alias("phrase"), F.lit(offset).alias("offset"), F.lit(len(p)).alias("size"), F.lit(term).alias("term")) for n, p in several for offset, term in enumerate(p)])
    met = rows.select("slot", "doc_id", "doc_length", "places", F.explode(F.filter(asked, lambda q: q["term"] == F.col("term"))).alias("q"))
    starts = met.select("slot", "doc_id", "doc_length", "q", F.explode("places").alias("place"))
    runs = (starts.groupBy("slot", "doc_id", "doc_length", F.col("q.phrase").alias("phrase"), F.col("q.size").alias("size"), (F.col("place") - F.col("q.offset")).alias("start"))
            .agg(F.count(F.lit(1)).alias("n")).where("n = size"))
    return materialize(runs.groupBy("phrase", "slot", "doc_id", "doc_length").agg(F.count(F.lit(1)).cast("int").alias("tf")), "phrase-counts")


def _single(index: Index, phrases: list[list[str]], slots: list[int] | None = None) -> DataFrame | None:
    """Blocks of the phrases of one term, with the phrase's number."""
    alone = {p[0]: n for n, p in enumerate(phrases) if len(p) == 1}
    if not alone:
        return None
    number = F.element_at(F.create_map(*[F.lit(x) for pair in alone.items() for x in pair]), F.col("term"))
    return index.blocks(sorted(alone), slots).withColumn("phrase", number)


class Query:
    """One query over one index: what its phrases weigh, and how high each slot can score."""

    def __init__(self, index: Index, phrases: list[list[str]], require_all: bool, weights: Weights):
        self.index, self.phrases, self.require_all, self.weights = index, _clean(phrases), require_all, weights
        self.n, self.avgdl = index.totals
        self.runs = _runs(index, self.phrases)
        heads, alone = [], _single(index, self.phrases)
        if alone is not None:
            heads.append(alone.select("phrase", "slot", "n", "max_tf", "min_length"))
        if self.runs is not None:
            heads.append(self.runs.groupBy("phrase", "slot").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("doc_length").alias("min_length")))
        self.heads = materialize(reduce(DataFrame.unionByName, heads), "heads") if heads else None
        held = {r.phrase: r.df for r in self.heads.groupBy("phrase").agg(F.sum("n").alias("df")).collect()} if heads else {}
        raw = {p: math.log((self.n - df + 0.5) / (df + 0.5)) if self.n - df > -0.5 else -1.0 for p, df in held.items()}
        self.idf = {p: x if x > 0 else weights.idf_floor for p, x in raw.items()}

    def weight(self, tf: Column, length: Column) -> Column:
        w = self.weights
        idf = F.element_at(F.create_map(*[F.lit(x) for pair in self.idf.items() for x in pair]), F.col("phrase"))
        return idf * tf * (w.k1 + 1) / (tf + w.k1 * (1 - w.b + w.b * length / self.avgdl))

    def answerable(self) -> bool:
        return bool(self.idf) and not (self.require_all and len(self.idf) < len(self.phrases))

    def none(self) -> DataFrame:
        return self.index.spark.createDataFrame([], "id long, score double")

    def bounds(self) -> DataFrame:
        """(slot, bound): no text of the slot scores higher."""
        best = self.heads.groupBy("slot").agg(F.sum(self.weight(F.col("max_tf"), F.col("min_length"))).alias("bound"), F.count(F.lit(1)).alias("held"))
        return best.where(F.col("held") >= len(self.phrases)).select("slot", "bound") if self.require_all else best.select("slot", "bound")

    def scores(self, slots: list[int] | None = None, within: DataFrame | None = None) -> DataFrame:
        """(id, score) of every matching text, of a short list of slots or those of a table."""
        found = []
        alone = _single(self.index, self.phrases, slots)
        if alone is not None:
            alone = alone.join(within, "slot", "left_semi") if within is not None else alone
            found.append(alone.select("phrase", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p")).select("phrase", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("doc_length")))
        if self.runs is not None:
            runs = self.runs if slots is None else self.runs.where(F.col("slot").isin(slots))
            runs = runs.join(within, "slot", "left_semi") if within is not None else runs
            found.append(runs.select("phrase", "doc_id", "tf", "doc_length"))
        rows = reduce(DataFrame.unionByName, found)
        scored = rows.groupBy(F.col("doc_id").alias("id")).agg(F.sum(self.weight(F.col("tf"), F.col("doc_length"))).alias("score"), F.count(F.lit(1)).alias("held"))
        return scored.where(F.col("held") >= (len(self.phrases) if self.require_all else 1)).select("id", "score")


#: Slots that are named in the second read itself; more of them are joined.
NAMED_SLOTS = 2_000
#: Scores are ranked by this many decimals, so a bound may fall short of a score by half of the last one.
DECIMALS = 9


def best_first() -> list[Column]:
    return [F.desc(F.round("score", DECIMALS)), F.asc("id")]


def top(query: Query, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The ``k`` best (id, score), of the ids in ``allowed`` if given.

    The slots with the highest bounds are scored first; their k-th best score
    leaves out every slot that cannot reach it.
    """
    if not query.answerable():
        return query.none()

    def passed(scored: DataFrame) -> DataFrame:
        return scored if allowed is None else scored.join(allowed.select("id"), "id", "left_semi")

    bounds = materialize(query.bounds(), "bounds")
    first = [r.slot for r in bounds.orderBy(F.desc("bound"), "slot").limit(k).collect()]  # k slots
    if not first:
        return query.none()
    lead = materialize(passed(query.scores(first)).orderBy(*best_first()).limit(k), "lead")
    have = lead.agg(F.count(F.lit(1)), F.min("score")).first()
    rest = bounds.where(~F.col("slot").isin(first))
    if have[0] >= k:
        rest = rest.where(F.col("bound") >= have[1] - 10.0 ** -DECIMALS)
    named = [r.slot for r in rest.select("slot").limit(NAMED_SLOTS + 1).collect()]
    if not named:
        return lead
    more = query.scores(named) if len(named) <= NAMED_SLOTS else query.scores(within=rest.select("slot"))
    return lead.unionByName(passed(more)).orderBy(*best_first()).limit(k)
