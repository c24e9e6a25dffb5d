"""The vote map's products on packed blocks, by entries where votes are sparse, against dense matrices."""

import numpy as np
import pytest

from votemill.operators import maps


def _votes(n, votes, each):
    rng = np.random.default_rng(2)
    x = np.zeros((votes, n))
    for row in x:
        row[rng.choice(n, rng.integers(1, each + 1), replace=False)] = 1
    return x * rng.choice([-1.0, 1.0], size=x.shape)


@pytest.mark.parametrize("n, each", [(3000, 9), (40, 30)])
def test_products_and_axes(spark, monkeypatch, n, each):
    monkeypatch.setattr(maps, "BLOCK_ENTRIES", 500)  # some blocks, cut inside Spark's batches
    x = _votes(n, 400, each)
    rows = [([2 * int(c) + int(r[c] < 0) for c in np.flatnonzero(r)],) for r in x]
    rows[0] = (rows[0][0] * 2,)  # a member named twice in a vote counts once
    # what sum of squares the full matrix has, with the repeated entries
    raw = np.vstack([2 * x[:1], x[1:]])
    energy = sum(len(c) - r.sum() ** 2 / n for (c,), r in zip(rows, raw))
    blocks = maps.vote_blocks(spark.createDataFrame(rows, "codes array<int>").repartition(3), n).localCheckpoint()
    assert 3 <= blocks.count() <= 400 and sum(r.entries for r in blocks.collect()) == np.count_nonzero(x)
    centred = x - x.mean(axis=1, keepdims=True)
    v = np.random.default_rng(3).normal(size=(n, 5))
    want = centred.T @ (centred @ v)
    assert np.allclose(maps._times(blocks, n, v), want)
    monkeypatch.setattr(maps, "DIRECT_BYTES", 0)
    assert np.allclose(maps._times(blocks, n, v), want)
    values, axes, got = maps._member_axes(blocks, n)
    assert np.allclose(values, np.linalg.svd(centred, compute_uv=False)[:2] ** 2) and np.isclose(got, energy)
    assert np.allclose(centred.T @ (centred @ axes), axes * values, atol=1e-5 * values[0])


def test_a_full_basis_is_restarted(monkeypatch):
    x = _votes(600, 900, 12)
    monkeypatch.setattr(maps, "_times", lambda rows, n, v: x.T @ (x @ v))

    class Rows:
        def agg(self, _):
            return self

        def first(self):
            return [1.0]

    values, axes, _ = maps._member_axes(Rows(), 600, width=4, most=24)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:2] ** 2)
    assert np.allclose(x.T @ (x @ axes), axes * values, atol=1e-5 * values[0])


def test_many_members_with_few_entries(spark):
    """A hundred thousand members: a dense slice of these votes would be 1.6 GB a task, the entries are 6,000."""
    n = 100_000
    rng = np.random.default_rng(4)
    rows = [(sorted(2 * int(c) for c in rng.choice(n, 3, replace=False)),) for _ in range(2000)]
    blocks = maps.vote_blocks(spark.createDataFrame(rows, "codes array<int>"), n)
    v = rng.normal(size=(n, 2))
    want = np.zeros_like(v)
    for (codes,) in rows:
        cols = np.array(codes) // 2
        y = v[cols].sum(axis=0) - 3 / n * v.sum(axis=0)
        want[cols] += y
        want -= 3 / n * y
    assert np.allclose(maps._times(blocks, n, v), want)
