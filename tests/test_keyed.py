"""Keyed tables in buckets: what a load reads, what a merge rewrites, loads during a merge."""

import glob
import os

from pyspark.sql import functions as F

from votemill.sources.keyed import KeyedTable


def _rows(spark, low, high, v):
    return spark.range(low, high).select(F.col("id").alias("k"), F.lit(v).alias("v"))


def _got(table, **how):
    return {r.k: r.v for r in table.current(**how).collect()}


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/lots/*/bucket=*/*.parquet")}


def test_merge_rewrites_changed_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ["k"], bucket_rows=50).upsert(_rows(spark, 0, 1600, "old"), 0)
    assert table.depth == 5
    before = _files(path)
    table = table.upsert(_rows(spark, 7, 9, "new"), 1)
    changed = {b for b, lots in table._live().items() if len(lots) > 1}
    table = table.merge()
    want = {k: "new" if k in (7, 8) else "old" for k in range(1600)}
    assert 1 <= len(changed) <= 2 and _got(table) == want
    table.clean()
    kept = _files(path)
    untouched = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in changed}
    assert untouched <= set(kept) and all(kept[f] == before[f] for f in untouched)
    assert not (set(before) - untouched) & set(kept)
    assert _got(table.newest()) == want and _got(KeyedTable(spark, path, ["k"])) == want


def test_load_during_a_merge(spark, tmp_path):
    """A merge that began before a load and ends after it loses none of its rows."""
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ["k"], bucket_rows=50).upsert(_rows(spark, 0, 200, "a"), 0).upsert(_rows(spark, 0, 100, "b"), 1)
    table.upsert(_rows(spark, 50, 60, "c"), 2)
    after = table.merge()  # of the version without the last load
    assert _got(after) == {k: "c" if 50 <= k < 60 else "b" if k < 100 else "a" for k in range(200)}
    assert _got(after.merge()) == _got(after)


def test_first_seen_reads_few_buckets(spark, tmp_path):
    """New keys are known to be new by the filters, however long the table is; known ones lead to their own buckets."""
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=40)
    for batch in range(3):
        table = table.add_new(_rows(spark, 2000 * batch, 2000 * (batch + 1), str(batch)), ["v"], batch)
        assert len(table.looked_up) <= 4
    assert table.depth == 8 and table.size == 6000
    again = table.add_new(_rows(spark, 10, 13, "late").unionByName(_rows(spark, 9000, 9300, "late")), ["v"], 3)
    assert 1 <= len(again.looked_up) <= 6
    assert _got(again) == {k: str(k // 2000) for k in range(6000)} | {k: "late" for k in range(9000, 9300)}
    assert again.add_new(_rows(spark, 20000, 20010, "replay"), ["v"], 3).size == again.size


def test_nulls_repeats_and_empty_batches(spark, tmp_path):
    schema = "k long, j string, v string"
    df = lambda *r: spark.createDataFrame(list(r), schema)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "j"]).add_new(df(), ["v"], 0)
    table = table.add_new(df((None, "a", "2"), (None, "a", "1"), (1, None, "x"), (1, None, "x")), ["v"], 1)
    table = table.add_new(df((None, "a", "0"), (1, None, None), (None, None, "n")), ["v"], 2)
    table = table.add_new(df(), ["v"], 3)
    got = {(r.k, r.j, r.v) for r in table.current().collect()}
    assert got == {(None, "a", "1"), (1, None, "x"), (None, None, "n")} and table.size == 3
