"""Whitening against numpy's eigenvalues and exact whole numbers."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from votemill.llm import queries, whitening


def _plain(rows, most=16):
    usable = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    side = max((len(v) for _, v in usable), default=0)
    whole = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v + [0.0] * (side - len(v))]) for i, v in usable]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return whole, n, sums, mean, covariance, values, vectors


def _check(got, rows, most=16):
    whole, n, sums, mean, covariance, values, vectors = _plain(rows, most)
    k = int((values > 1e-9 * values[0]).sum())
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert len(got) == k * len(whole)
    assert Counter(r.component for r in got) == {c: len(whole) for c in range(1, k + 1)}
    sign = {}

    def far(x):
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        return exact if exact < 1 << 63 else None

    for i, x in whole:
        deviation = far(x)
        want = ((np.array(x, float) - mean) @ vectors[:, :k]) / np.sqrt(values[:k])
        for r in by_id[i][:]:
            if r.deviation != deviation:
                continue  # another row with this id
            assert r.n == n
            assert abs(r.explained - values[r.component - 1] / np.trace(covariance)) <= 1e-9
            assert r.identity_error <= 1e-6
            if abs(want[r.component - 1]) > 1e-3:
                s = sign.setdefault(r.component, np.sign(r.whitened * want[r.component - 1]))
                assert abs(s * r.whitened - want[r.component - 1]) < 1e-6 * max(1, abs(want[r.component - 1]))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, far(x)) for i, x in whole)


def test_op13_on_awkward_rows(spark, nasty):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{nasty}/embeddings.parquet").collect()]
    _check(queries.op13_whitening(spark, nasty).collect(), rows)


def test_op13_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    _check(queries.op13_whitening(spark, folder).collect(), rows)


@pytest.mark.parametrize("case", ["short", "wide", "one", "constant", "double", "line"])
def test_other_tables(spark, case):
    rng = np.random.default_rng(1)
    if case == "short":  # short vectors, one equal to another one filled up
        rows = [(k, rng.normal(size=3).tolist()) for k in range(30)] + [(40, []), (41, [0.0, 0.0, 0.0]), (42, [1.5]), (43, [1.5, 0.0])]
    elif case == "wide":  # numbers beyond 32 bits
        rows = [(k, (rng.normal(size=3) * [1e9, 1, 1e-2]).tolist()) for k in range(40)]
    elif case == "one":
        rows = [(k, [0.5, 1.0]) for k in range(5)]
    elif case == "constant":  # a dimension without variance
        rows = [(k, [float(k), 7.0, float(k * k % 11)]) for k in range(25)]
    elif case == "line":  # rank one
        rows = [(k, [float(k), 2.0 * k, -1.0 * k]) for k in range(25)]
    else:  # two equal eigenvalues
        rows = [(k, [float(a), float(b)]) for k, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    if case == "one":
        assert got == []
    elif case == "double":
        assert len(got) == 8 and all(r.identity_error < 1e-9 and abs(r.explained - 0.5) < 1e-9 for r in got)
    else:
        _check(got, rows)


def _random(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 8, 20):
        for _ in range(30):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if rng.random() < 0.5:
                np.fill_diagonal(a, 0)  # needs pivots of two
            values = np.linalg.eigvalsh(a)
            for shift in rng.normal(size=5) * 2:
                assert whitening.inertia(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [5, 5, 5, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0], [1e9, 1, 1e-3, 0, 0], [3, 3 - 1e-6, 3 - 2e-6, 3 - 3e-6, 1e-8] + [0] * 10,
                                    list(np.linspace(2, 1, 64)), [1.0] * 12])
def test_leading_pairs(values):
    a = _random(values)
    got, vectors = whitening.Spectrum((a + a.T) / 2).leading(16)
    want = sorted((v for v in values if v > 1e-11 * max(values)), reverse=True)[:16]
    assert len(got) == len(want) and np.abs(got - want).max() <= 1e-11 * max(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-10
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-10 * max(values)


def test_exact_beyond_longs():
    y = np.array([[3_000_000_000, 1], [-3_000_000_000, 2]])
    assert whitening.products(y)[0, 0] == 2 * 9 * 10 ** 18
    assert whitening.deviations(np.array([[1, 2], [10 ** 9, 0]]), 10, [3, 4]) == [7 ** 2 + 16 ** 2, None]
