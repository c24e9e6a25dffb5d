"""Pages and vectors: archives read back, neighbours against brute force."""

from collections import Counter, defaultdict

import numpy as np
from pyarrow import fs

import brute
from votemill.llm import ann, queries, warc


def test_op6(spark, nasty):
    pages = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{nasty}/pages.parquet").collect()]
    want = Counter()
    for i, html in pages:
        data = html.encode()
        same = [k for k, other in pages if other == html and k is not None]
        first = min(same) if same and len(data) >= 100 else None
        refers = first if first is not None and i != first else None
        want[i, len(data), brute.sha(data), "response" if refers is None else "revisit", refers] += 1
    got = queries.op6_warc(spark, nasty)
    assert Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_a_selection_reads_its_records_only(spark, nasty):
    index = warc.archive(spark.read.parquet(f"{nasty}/pages.parquet"))
    got = warc.read(index.where("page_id in ('4', '7', '3')")).collect()
    assert {(r.page_id, bytes(r.payload) if r.payload is not None else None) for r in got} >= {("4", b"short"), ("7", ("ü" * 40).encode())}
    assert len(got) == 3 and {r.url for r in got} >= {"http://é/7"}
    one = index.where("record_type = 'response' and page_id = '4'").first()
    store, path = fs.FileSystem.from_uri(f"{one.folder}/{one.file}")
    with store.open_input_file(path) as f:
        assert f.read_at(2, one.offset) == b"\x1f\x8b"  # a gzip member of its own


def test_neighbouring_ranges_are_one_read():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 500, 5), ("b", 0, 9), ("b", 9, 90)]
    assert [len(g) for g in warc.ranges(rows, gap=30, most=60)] == [3, 1, 1, 1]


def _brute(vectors, k):
    out = {}
    for q in (i for i in vectors if i % 20 == 0):
        near = sorted(((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def test_op8(spark, nasty):
    usable = {}
    for r in spark.read.parquet(f"{nasty}/embeddings.parquet").collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[r.vec_id] = np.array(v, float)
    got = defaultdict(list)
    for r in queries.op8_ann(spark, nasty).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = _brute(usable, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert [i for i, _ in got[200]] == [i for i, _ in want[200]]  # ties go to the smaller id


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(1500, 48)) * rng.uniform(0.5, 2, (1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F
    found = ann.search(df, F.col("id") % 20 == 0, settings=ann.Settings(segment_rows=600, block_rows=32)).collect()
    want = _brute(dict(enumerate(data)), 20)
    exact = {(q, i): s for q, near in want.items() for i, s in near}
    hits = [(r.query_id, r.vec_id) for r in found if (r.query_id, r.vec_id) in exact]
    assert len(found) == 20 * len(want) and len(hits) >= 0.9 * len(found)
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-9 for r in found if (r.query_id, r.vec_id) in exact)


def test_fewer_rows_than_neighbours(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("id") == 0).orderBy("rank").collect()] == [(1, 2, 2.0), (2, 1, 0.5)]
