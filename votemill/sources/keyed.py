"""Keyed tables in hash buckets: a load or a merge touches its own buckets only.

A table is a folder of *lots*, one for every load or merge, each cut into
folders of its buckets (``lots/lot=.../bucket=...``).  The newest numbered
folder below ``manifest`` names the files that count, and is put in place last
by a rename, so readers and a merge that run during a load see whole versions.
Buckets are hashes of the key, or of a part of it.  The first load makes so many that one holds up
to ``bucket_rows`` rows; a load that would bring them to twice as many on average
rewrites the table in more buckets first, so a bucket stays small however long
the table lives.

Loads of first-seen keys hold a Bloom filter of every bucket next to the table
and read only the buckets in which a key of the load may already be.  Merges
rewrite the buckets that more than one lot has written; all other files stay.

One load runs at a time; a merge may run meanwhile.  A null in a key is a value
like any other.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from votemill.operators.relational import best_per_key, first_per_key
from votemill.runtime import materialize, ship

#: kind "lot" or "bloom": the folder, the bucket, its rows; "run": the name of a run and its last batch; "depth": buckets as a power of two.
MANIFEST = "kind string, name string, bucket int, n long"
BITS_PER_KEY, PROBES = 16, 11


def _set(bits: np.ndarray, hashes: np.ndarray) -> None:
    for at in _places(hashes, 8 * len(bits)):
        np.bitwise_or.at(bits, at >> np.uint64(3), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(bits)):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    code = hashes.view(np.uint64)
    step = code >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield (code + np.uint64(i) * step) % np.uint64(size)


class KeyedTable:
    """The newest version of the table below ``path``; loads and merges return the version they make."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_rows: int = 1 << 16, bucket_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.bucket_rows = spark, path, keys, bucket_rows
        #: the part of the key whose hash is the bucket
        self.bucket_by = bucket_by or keys
        self.version = max(self._versions(), default=0)
        self.rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{self.version}").collect() if self.version else []  # a row per bucket and lot
        self.depth = next((r.n for r in self.rows if r.kind == "depth"), 0)
        #: buckets that the load which made this version has read
        self.looked_up: list[int] = []

    # --- versions ------------------------------------------------------------------------
    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, files = self._files(path)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def _versions(self) -> list[int]:
        return [int(n) for n in self._names(f"{self.path}/manifest") if n.isdigit()]

    def newest(self) -> KeyedTable:
        return KeyedTable(self.spark, self.path, self.keys, self.bucket_rows, self.bucket_by)

    def _commit(self, change: Callable[[KeyedTable], list[tuple]]) -> KeyedTable:
        """A new version with the rows that ``change`` makes of the newest one; anew if another was quicker."""
        while True:
            newest = self.newest()
            own = f"_new-{uuid.uuid4().hex}"
            self.spark.createDataFrame(change(newest), MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{own}")
            (source, files), (target, _) = self._files(f"{self.path}/manifest/{own}"), self._files(f"{self.path}/manifest/{newest.version + 1}")
            # a rename onto a folder that exists fails or moves into it
            moved = not files.exists(target) and files.rename(source, target)
            late, _ = self._files(f"{self.path}/manifest/{newest.version + 1}/{own}")
            if moved and not files.exists(late):
                return self.newest()
            files.delete(late if files.exists(late) else source, True)

    def _live(self, kind: str = "lot") -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for r in self.rows:
            if r.kind == kind:
                out.setdefault(r.bucket, []).append(r.name)
        return out

    @property
    def size(self) -> int:
        """Rows of all lots."""
        return sum(r.n for r in self.rows if r.kind == "lot")

    # --- reading -------------------------------------------------------------------------
    def _schema(self) -> T.StructType:
        lot = next(r.name for r in reversed(self.rows) if r.kind == "lot")
        schema = self.spark.read.parquet(f"{self.path}/lots/lot={lot}").schema
        return T.StructType([f for f in schema if f.name != "bucket"] + [T.StructField("lot", T.StringType()), T.StructField("bucket", T.IntegerType())])

    def _read(self, places: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/lots/lot={lot}/bucket={b}" for b, lots in places.items() for lot in lots]
        return self.spark.read.schema(self._schema()).option("basePath", f"{self.path}/lots").parquet(*paths)

    def current(self, last_wins: bool = True) -> DataFrame:
        """One row per key: of the newest lot, or of the first.  Buckets of a single lot are read as they are."""
        if not self._live():
            raise ValueError(f"no rows below {self.path}")
        return self._of(self._live(), last_wins)

    def matching(self, rows: DataFrame, last_wins: bool = True) -> DataFrame | None:
        """Of ``current`` the rows whose ``bucket_by`` columns stand in ``rows``; reads only the buckets those fall into."""
        wanted, live = rows.select(*self.bucket_by).distinct(), self._live()
        touched = {r["bucket"] for r in wanted.select(self._bucket(self.depth).alias("bucket")).distinct().collect()} & set(live)
        self.looked_up = sorted(touched)
        if not touched:
            return None
        known = wanted.select(*[F.col(k).alias(f"_wanted_{i}") for i, k in enumerate(self.bucket_by)])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_wanted_{i}")) for i, k in enumerate(self.bucket_by)])
        return self._of({b: live[b] for b in touched}, last_wins).join(known, same, "left_semi")

    def _of(self, live: dict[int, list[str]], last_wins: bool) -> DataFrame:
        single, mixed = {b: x for b, x in live.items() if len(x) == 1}, {b: x for b, x in live.items() if len(x) > 1}
        parts = [self._read(single)] if single else []
        if mixed:
            parts.append(self._merged(mixed, last_wins))
        return reduce(DataFrame.unionByName, [p.drop("lot", "bucket") for p in parts])

    def _merged(self, places: dict[int, list[str]], last_wins: bool) -> DataFrame:
        # the names of lots, which order them, as their place in that order
        names = sorted({lot for lots in places.values() for lot in lots}, reverse=last_wins)
        place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lot"))
        return best_per_key(self._read(places), self.keys, [place])

    # --- writing -------------------------------------------------------------------------
    def _bucket(self, depth: int) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(1 << depth)).cast("int")

    def _lot(self, number: int) -> str:
        return f"{number:010d}-{uuid.uuid4().hex[:8]}"

    def _next(self) -> int:
        return max([0, *[int(r.name.split("-")[0]) for r in self.rows if r.kind == "lot"]]) + 1

    def _write(self, df: DataFrame, lot: str) -> list[tuple]:
        """Writes rows with their column ``bucket``; (kind, name, bucket, n) of each bucket written."""
        df.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/lots/lot={lot}")
        if not any(n.startswith("bucket=") for n in self._names(f"{self.path}/lots/lot={lot}")):
            return []
        counts = self.spark.read.parquet(f"{self.path}/lots/lot={lot}").groupBy("bucket").count().collect()
        return [("lot", lot, r["bucket"], r["count"]) for r in counts]

    def _grown(self, more: int) -> KeyedTable:
        """The table with buckets enough for ``more`` rows."""
        depth = max(0, math.ceil(math.log2(max(1, self.size + more) / self.bucket_rows)))
        if depth <= self.depth or self._live() and self.size + more <= 2 * self.bucket_rows << self.depth:
            return self
        if self._live():
            return self.merge(depth=depth)
        return self._commit(lambda newest: [tuple(r) for r in newest.rows if r.kind != "depth"] + [("depth", "", None, depth)])

    def _done(self, run: int, batch: int) -> bool:
        return any(r.kind == "run" and r.name == str(run) and r.n >= batch for r in self.rows)

    def _load(self, rows: DataFrame, batch: int, run: int, blooms: bool) -> KeyedTable:
        """Writes one row per key as a lot; ``rows`` has the column ``bucket``."""
        lot = self._lot(self._next())
        written = self._write(rows, lot)
        filters = self._write_blooms(lot, [w[2] for w in written]) if blooms and written else []
        fresh = {w[2] for w in filters}

        def change(newest: KeyedTable) -> list[tuple]:
            if newest.depth != self.depth:
                raise RuntimeError("the table got new buckets during a load: load the batch again")
            kept = [tuple(r) for r in newest.rows if not (r.kind == "run" and r.name == str(run)) and not (r.kind == "bloom" and r.bucket in fresh)]
            return [*kept, *written, *filters, ("run", str(run), None, batch)]

        return self._commit(change)

    def upsert(self, df: DataFrame, batch: int, run: int = 1, order: list[str] | None = None) -> KeyedTable:
        """Adds a batch whose rows replace those of the same key; of a key's rows in a batch the one first by ``order`` counts.

        A batch that the table has already is left out.
        """
        if self._done(run, batch):
            return self
        rows = materialize(first_per_key(df, self.keys, order or []), "upserts")
        table = self._grown(rows.count())
        return table._load(rows.withColumn("bucket", table._bucket(table.depth)), batch, run, blooms=False)

    def add_new(self, df: DataFrame, order: list[str], batch: int, run: int = 1) -> KeyedTable:
        """Adds of a batch the first row by ``order`` of each key that the table does not have.

        Reads the Bloom filters of the buckets that the batch falls into, and
        the keys of those buckets in which one of its keys may already be.
        """
        if self._done(run, batch):
            return self
        first = materialize(first_per_key(df, self.keys, order), "first-seen")
        table = self._grown(first.count())
        rows = first.withColumn("bucket", table._bucket(table.depth))
        live = table._live()
        touched = sorted({r["bucket"] for r in rows.select("bucket").distinct().collect()} & set(live))
        looked: list[int] = []
        if touched:
            marked = materialize(table._marked(rows, touched), "marked")
            looked = sorted(r["bucket"] for r in marked.where("maybe").select("bucket").distinct().collect())
            rows = marked.where("not maybe").drop("maybe")
            if looked:
                known = table._read({b: live[b] for b in looked}).select(*[F.col(k).alias(f"_known_{i}") for i, k in enumerate(self.keys)])
                same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_known_{i}")) for i, k in enumerate(self.keys)])
                rows = rows.unionByName(marked.where("maybe").drop("maybe").join(known, same, "left_anti"))
        new = table._load(rows, batch, run, blooms=True)
        new.looked_up = looked
        return new

    def run_number(self, checkpoint: str) -> int:
        """The number of the run that a checkpoint belongs to; a new (or lost and renewed) checkpoint gets the next one."""
        own = f"{checkpoint}/run-number"
        folder, files = self._files(f"{own}/_SUCCESS")
        if files.exists(folder):
            return self.spark.read.schema("run int").parquet(own).first()["run"]
        run = max([0, *[int(r.name) for r in self.rows if r.kind == "run"]]) + 1
        self.spark.createDataFrame([(run,)], "run int").coalesce(1).write.mode("overwrite").parquet(own)
        return run

    # --- Bloom filters -------------------------------------------------------------------
    def _hash(self) -> Column:
        return F.xxhash64(F.lit("bloom"), *self.keys)

    def _blooms(self, buckets: list[int]) -> DataFrame | None:
        """(bucket, bits) of the buckets that have a filter."""
        live = self._live("bloom")
        paths = [f"{self.path}/blooms/lot={name}/bucket={b}" for b in buckets for name in live.get(b, [])]
        if not paths:
            return None
        return self.spark.read.schema("bits binary, lot string, bucket int").option("basePath", f"{self.path}/blooms").parquet(*paths).select("bucket", "bits")

    def _met(self, rows: DataFrame, buckets: list[int]) -> DataFrame:
        """Rows (bucket, kind, hash, row), and in front of those of each bucket its filter as (bucket, 0, bits)."""
        out = rows.withColumns({"kind": F.lit(1), "bits": F.lit(None).cast("binary")})
        filters = self._blooms(buckets)
        if filters is not None:
            out = out.unionByName(filters.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        return out.repartition("bucket").sortWithinPartitions("bucket", "kind").select("bucket", "kind", "bits", *[c for c in rows.columns if c != "bucket"])

    def _marked(self, rows: DataFrame, buckets: list[int]) -> DataFrame:
        """Rows with ``maybe``: whether the filter of their bucket knows the key."""
        ship(self.spark)
        met = self._met(rows.select("bucket", self._hash().alias("hash"), F.struct(*[c for c in rows.columns if c != "bucket"]).alias("row")), buckets)
        row_type = met.schema["row"].dataType
        schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("row", row_type), T.StructField("maybe", T.BooleanType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bits = None, None
            for batch in batches:
                buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                edges = np.flatnonzero((np.diff(buckets) != 0) | (np.diff(kinds) != 0)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
                    if a == b:
                        continue
                    if buckets[a] != now:
                        now, bits = buckets[a], None
                    if kinds[a] == 0:
                        bits = np.frombuffer(batch.column(2)[b - 1].as_py(), np.uint8)
                        continue
                    part = batch.slice(a, b - a)
                    hashes = part.column(3).to_numpy()
                    found = _holds(bits, hashes) if bits is not None else np.zeros(len(hashes), bool)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), pa.array(found)], names=schema.fieldNames())

        return met.mapInArrow(run, schema).select("bucket", "row.*", "maybe")

    def _write_blooms(self, lot: str, buckets: list[int], anew: bool = False) -> list[tuple]:
        """Writes the filters of ``buckets`` with the keys of a lot added, or of these alone."""
        ship(self.spark)
        size = 1 << max(3, math.ceil(math.log2(BITS_PER_KEY * self.bucket_rows)) - 3)
        keys = self.spark.read.parquet(f"{self.path}/lots/lot={lot}").select("bucket", self._hash().alias("hash"))
        met = self._met(keys, [] if anew else buckets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bits = None, np.zeros(size, np.uint8)

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["bucket", "bits"])

            for batch in batches:
                owners, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                edges = np.flatnonzero((np.diff(owners) != 0) | (np.diff(kinds) != 0)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(owners)]):
                    if a == b:
                        continue
                    if owners[a] != now:
                        if now is not None:
                            yield made()
                        now, bits = int(owners[a]), np.zeros(size, np.uint8)
                    if kinds[a] == 0:
                        bits |= np.frombuffer(batch.column(2)[b - 1].as_py(), np.uint8)
                    else:
                        _set(bits, batch.column(3).slice(a, b - a).to_numpy())
            if now is not None:
                yield made()

        made = met.mapInArrow(run, "bucket int, bits binary")
        made.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/blooms/lot={lot}")
        return [("bloom", lot, b, size) for b in buckets]

    # --- merging -------------------------------------------------------------------------
    def merge(self, last_wins: bool = True, depth: int | None = None) -> KeyedTable:
        """Rewrites the buckets that several lots have written, or with a new ``depth`` all; loads may run meanwhile."""
        grow = depth is not None and depth != self.depth
        merged = {b: lots for b, lots in self._live().items() if grow or len(lots) > 1}
        if not merged:
            return self
        blooms = bool(self._live("bloom"))
        # below the number of every load that starts from now on
        lot = self._lot(self._next() - 1)
        rows = self._merged(merged, last_wins).drop("lot", "bucket").withColumn("bucket", self._bucket(depth if grow else self.depth))
        written = self._write(rows, lot)
        filters = self._write_blooms(lot, [w[2] for w in written], anew=True) if grow and blooms else []
        gone = {(b, name) for b, lots in merged.items() for name in lots}

        def change(newest: KeyedTable) -> list[tuple]:
            here = {(r.bucket, r.name) for r in newest.rows if r.kind == "lot"}
            if not gone <= here or (grow and here != gone):
                raise RuntimeError("another merge or load changed these buckets: merge again")
            kept = [tuple(r) for r in newest.rows if not (r.kind == "lot" and (r.bucket, r.name) in gone)
                    and not (grow and r.kind in ("bloom", "depth"))]
            return [*kept, *written, *filters, *([("depth", "", None, depth)] if grow else [])]

        return self._commit(change)

    def clean(self) -> None:
        """Deletes files and versions that do not count any more; no reader of an older version may run."""
        used = {("lots", r.name, r.bucket) for r in self.rows if r.kind == "lot"} | {("blooms", r.name, r.bucket) for r in self.rows if r.kind == "bloom"}
        places = [f"{self.path}/manifest/{v}" for v in self._versions() if v < self.version]
        for kind in ("lots", "blooms"):
            for lot in self._names(f"{self.path}/{kind}"):
                inside = [n for n in self._names(f"{self.path}/{kind}/{lot}") if n.startswith("bucket=")]
                dead = [n for n in inside if (kind, lot[4:], int(n[7:])) not in used]
                places += [f"{self.path}/{kind}/{lot}"] if len(dead) == len(inside) else [f"{self.path}/{kind}/{lot}/{n}" for n in dead]
        for place in places:
            folder, files = self._files(place)
            files.delete(folder, True)
