"""Inverted lists of vectors against the exact scan."""

import numpy as np
from pyspark.sql import functions as F

from votemill.operators import vector_index as V
from votemill.operators.search import cosine_top_k


def _clustered():
    rng = np.random.default_rng(8)
    return np.repeat(rng.normal(size=(60, 32)), 50, axis=0) + 0.3 * rng.normal(size=(3000, 32))


def _frame(spark, data):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")


def _recall(index, df, data, step=50, k=30):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    got = {}
    for r in index.nearest_each(df.where(f"vec_id % {step} = 0"), "vec_id", "embedding", k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    hits = 0
    for q in range(0, len(data), step):
        exact = unit @ unit[q]
        assert all(abs(exact[i] - s) < 1e-8 for _, i, s in got[q]) and [r for r, *_ in sorted(got[q])] == list(range(1, k + 1))
        hits += len({i for _, i, _ in got[q]} & set(np.argsort(-exact)[:k].tolist()))
    return hits / (k * len(range(0, len(data), step)))


def test_recall_and_share_read(spark, tmp_path):
    data = _clustered()
    df = _frame(spark, data)
    index = V.build(df, "vec_id", "embedding", str(tmp_path / "i"), V.Settings(cells=60))
    assert index.rows.count() == len(data) and len(index.centres) == 60
    assert _recall(index, df, data) >= 0.9
    assert index.probes <= 20
    found = index.nearest(df.where("vec_id = 7").select("embedding"), 30, "vec_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    exact = cosine_top_k(df, "vec_id", "embedding", df.where("vec_id = 7").select("embedding"), 30)
    same = {(r.vec_id, r.score) for r in found.collect()} & {(r.vec_id, r.score) for r in exact.collect()}
    assert len(same) >= 27


def test_recall_without_clusters(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id")
    data = np.array([r.embedding for r in df.collect()], float)
    index = V.build(df, "vec_id", "embedding", str(tmp_path / "i"))
    assert _recall(index, df, data) >= 0.9


def test_awkward_vectors(spark, tmp_path):
    rows = [(i, [1.0, float(i % 3)]) for i in range(12)] + [(20, None), (21, [0.0, 0.0]), (22, [1.0, None]), (23, [float("nan"), 1.0]), (24, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "cell": F.lit("y"), "vec": F.lit("z")})
    index = V.build(df, "vec_id", "embedding", str(tmp_path / "i"))
    assert {r.id for r in index.rows.collect()} == set(range(12))
    probe = df.where("vec_id = 0").select("embedding")
    assert [r.id for r in index.nearest(probe, 30).collect()][:4] == [0, 3, 6, 9] and index.nearest(probe, 30).count() == 12
    empty = V.build(df.limit(0), "vec_id", "embedding", str(tmp_path / "e"))
    assert empty.nearest(probe).count() == 0 and empty.nearest_each(df, "vec_id", "embedding").count() == 0


def test_cells_met_in_blocks_find_what_single_products_find(spark, tmp_path, monkeypatch):
    data = np.concatenate([_clustered()[:900], np.repeat(_clustered()[:40], 3, axis=0)])  # with ties
    df = _frame(spark, data)
    index = V.build(df, "vec_id", "embedding", str(tmp_path / "i"), V.Settings(cells=12))
    monkeypatch.setattr(V.VectorIndex, "_row_lots", lambda self: 3)
    monkeypatch.setattr(V.VectorIndex, "_query_lots", lambda self, asked: 2)
    queries = df.where("vec_id % 9 = 0")
    found = index.nearest_each(queries, "vec_id", "embedding", 7)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    rows = {r.id: (np.array(r.vec), r.cell) for r in index.rows.collect()}
    for q in range(0, len(data), 9):
        unit = rows[q][0]
        near = set(index.cells(unit))
        scores = []
        for i, (v, cell) in rows.items():
            if cell in near:
                dot = 0.0
                for a, b in zip(v, unit):
                    dot += a * b
                scores.append((-round(dot, 9), i))
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:7]]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan  # no row for each query and row of a cell


def test_bounds_and_rows_held_are_bounded():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(30, 4)), rng.normal(size=(400, 4))
    best, out = V._Best(5, most_queries=12, most_rows=40), []
    for low in range(0, 400, 50):
        for at in range(0, 30, 10):
            part, rows = q[at:at + 10], x[low:low + 50]
            out += best.add(pa.array(range(at, at + 10)), pa.array(part.tolist()), pa.array(range(low, low + 50)), pa.array(rows.tolist()))
    out += best.held_rows()
    found = {}
    for b in out:
        for i, j, d in zip(*(c.to_pylist() for c in b.columns)):
            found.setdefault(i, []).append((-d, j))
    for i in range(30):
        assert [j for _, j in sorted(found[i])[:5]] == np.argsort(-(x @ q[i]), kind="stable")[:5].tolist()
