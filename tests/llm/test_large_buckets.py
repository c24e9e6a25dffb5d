"""Suffix buckets larger than a task may hold."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from votemill.llm import suffix_dedup as sd


def _texts():
    r = random.Random(4)
    shared = brute._prose(5, 90)[:430]
    rows = [(i, "".join(r.choices("abcdefgh ", k=300)) + shared + "".join(r.choices("abcdefgh ", k=300))) for i in range(60)]
    whole = brute._prose(6, 200)
    rows += [(100 + i, whole) for i in range(20)] + [(200 + i, whole[:-i] + "x" * i) for i in range(1, 20)]
    rows += [(300, None), (301, "short"), (302, "b" * 1200), (303, shared + whole)]
    return rows


@pytest.mark.parametrize("most", [0, 60_000, 16 << 20])
def test_dealt_out_buckets(spark, most, tmp_path):
    rows = _texts()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents"))
    df = spark.read.parquet(str(tmp_path / "documents"))
    got = sd.dedup(df, keep=["doc_id"], settings=sd.Settings(bucket_bytes=most)).collect()
    assert Counter((r["row"].doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == Counter((i, n, spans, kept) for i, n, _, spans, kept in brute.cut(rows))


def test_no_task_holds_a_large_bucket(spark):
    """The 60 texts around a shared passage make runs of one string; at a bound of 60,000 bytes they are not held together."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(_texts()[:60], "doc_id long, text string").select(F.col("doc_id").alias("uid"), "text").repartition(4)
    whole = [(r.uid, r.text, bytearray(sd._pairs(np.arange(len(r.text.encode()) - 399)))) for r in df.collect()]
    texts = spark.createDataFrame(whole, "uid long, text string, starts binary").repartition(4)
    settings = sd.Settings(bucket_bytes=60_000)
    heavy = sd._heavy_classes(texts, settings)
    assert len(heavy)
    held = {r.bucket: r.weight for r in sd._runs(texts, settings, True, heavy).groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("weight")).collect()}
    before = {r.bucket: r.weight for r in sd._runs(texts, settings, True).groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("weight")).collect()}
    assert max(before.values()) > 20_000 and max(held.values()) < 20_000


def test_ties_are_broken_by_bytes_alone(monkeypatch):
    """Runs of one bucket that differ in one byte, at every place of a string, with every hash of the bucket step out of use."""
    monkeypatch.setattr(sd.tb, "span_hash", None)
    monkeypatch.setattr(sd.tb, "window_hash", None)
    for settings in (sd.Settings(), sd.Settings(length=200, q=7)):
        cover, length, anchor = sd.Cover(settings), settings.length, bytes(range(200, 232))
        r, runs = random.Random(7), []
        base = bytes(r.choices(b"ab", k=length - 32)) + anchor + bytes(r.choices(b"ab", k=length - 32))
        for k in range(0, len(base), 3):
            runs.append((3 + k % 2, base[:k] + b"c" + base[k + 1:], 1, length - 32))
        runs += [(4, base[10:], 1, length - 42), (3, base[:-20], 2, length - 32), (9, base, 1, length - 32)]
        bucket, texts, counts, mid = zip(*runs)
        got = sd.repeats(np.array(bucket), list(texts), np.array(counts), np.array(mid), cover, settings)
        seen = Counter()
        for b, t, n, m in runs:
            seen.update({(b, m - p, t[p:p + length]): n for p in range(len(t) - length + 1)})
        want = [[p for p in range(len(t) - length + 1) if seen[b, m - p, t[p:p + length]] > 1] for b, t, n, m in runs]
        assert [g.tolist() for g in got] == want and any(want) and want[-1] == []
