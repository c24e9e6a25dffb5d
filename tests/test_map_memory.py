"""The vote map's driver holds few vectors as long as the member list."""

import tracemalloc

import numpy as np

from votemill.operators import maps


def test_few_vectors_on_the_driver(spark, monkeypatch):
    n = 4000
    votes = np.random.default_rng(0).choice([-1.0, 0.0, 1.0], size=(700, n))

    class Rows:
        def agg(self, _):
            return self

        def first(self):
            return [1.0]

    monkeypatch.setattr(maps, "_times", lambda rows, n, x: votes.T @ (votes @ x))
    tracemalloc.start()
    values, axes, _ = maps._member_axes(Rows(), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * 600
    want = np.linalg.svd(votes, compute_uv=False)[:2] ** 2
    assert np.allclose(values, want) and np.allclose(votes.T @ (votes @ axes), axes * values, atol=1e-5 * values[0])
