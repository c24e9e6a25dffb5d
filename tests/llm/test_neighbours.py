"""Neighbours of vectors of very different lengths, and in tables smaller than k."""

import numpy as np
import pytest

from votemill.llm import ann


def _skewed(kind, rng):
    data = rng.normal(size=(1200, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    if kind == "one":
        data[7] *= 100
    elif kind == "all":
        data *= np.exp(rng.normal(size=(1200, 1)))
    else:
        data = data[:15] * np.exp(rng.normal(size=(15, 1)))
    return data


@pytest.mark.parametrize("kind", ["one", "all", "few"])
def test_skewed_lengths(spark, kind):
    from pyspark.sql import functions as F
    data = _skewed(kind, np.random.default_rng(3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0, settings=ann.Settings(segment_rows=500, block_rows=32)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = wanted = 0
    for q in range(0, len(data), 20):
        best = [i for i in np.argsort(-(data @ data[q]), kind="stable").tolist() if i != q][:20]
        assert len(got[q]) == len(best)
        hits, wanted = hits + len(got[q] & set(best)), wanted + len(best)
    assert hits >= 0.95 * wanted


def test_products_of_candidates_only(spark):
    """On clustered vectors most rows never meet a query."""
    rng = np.random.default_rng(4)
    data = np.repeat(rng.normal(size=(40, 64)), 50, axis=0) + 0.25 * rng.normal(size=(2000, 64))
    settings = ann.Settings()
    segment = ann.Segment(np.arange(2000), data, ann.Rotations(64, settings), settings)
    asked = np.arange(0, 2000, 20)
    hits = 0
    for query, ids, scores in segment.search(asked, data[asked], 20):
        exact = data @ data[query]
        exact[query] = -np.inf
        hits += len(set(ids.tolist()) & set(np.argsort(-exact)[:20].tolist()))
        assert np.allclose(scores, exact[ids])
    assert hits >= 0.9 * 20 * len(asked)
    assert segment.products < 0.5 * len(asked) * len(data)
