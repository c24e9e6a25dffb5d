"""Operators that replace a single-task or single-machine step, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from votemill.operators import language, maps, relational as R
from votemill.runtime import global_rank, materialize


def test_global_rank_with_hot_value(spark):
    rng = np.random.default_rng(3)
    data = [("a" if i % 3 else "b", 0.0 if i % 2 else float(rng.integers(0, 50)), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double, id long").repartition(5)
    got = global_rank(df, "g", "v", "id").collect()
    for g in "ab":
        want = {i: k for k, (_, i) in enumerate(sorted((v, i) for gg, v, i in data if gg == g))}
        mine = {r.id: r.rank0 for r in got if r.g == g}
        assert mine == want and {r.total for r in got if r.g == g} == {len(want)}


def test_ratings(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, None), (3, 9.0, None), (4, None, None)], "id long, x double, y double")
    got = {r.id: (r.x, r.y) for r in R.percentile_ratings(df, "id", ["x", "y"]).collect()}
    assert got == {1: (1, 50), 2: (50, None), 3: (99, None), 4: (None, None)}


def member_votes(spark, n_members=24, n_votes=60):
    rng = np.random.default_rng(11)
    sign = np.where(np.arange(n_members) % 3 == 0, 1, -1)
    x = np.zeros((n_members, n_votes))
    for j in range(n_votes):
        x[:, j] = np.where(rng.random(n_members) < 0.15, -1, 1) * (sign if j % 2 else np.where(np.arange(n_members) < 9, 1, -1))
        x[rng.random(n_members) < 0.1, j] = 0
    name = {1: "Jaa", -1: "Ei", 0: "Poissa"}
    rec = spark.createDataFrame([(j, i, name[int(x[i, j])]) for i in range(n_members) for j in range(n_votes)], "vote_id long, person_id long, vote_value string")
    vote = spark.createDataFrame([(j, 2024, 0) for j in range(n_votes)], "vote_id long, vp_year int, is_procedural int")
    person = spark.createDataFrame([(i, ("sd", "kok", "vihr")[i % 3]) for i in range(n_members)], "person_id long, party_current string")
    return x, rec, vote, person


def check_map(x, out):
    xc = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(xc, full_matrices=False)
    got = {r.person_id: r for r in out.collect()}
    for k, dim in enumerate(("dim1", "dim2")):
        c = u[:, k] * s[k]
        want = 200 * (c - c.min()) / (c.max() - c.min()) - 100
        mine = np.array([got[i][dim] for i in range(len(x))])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
    share = s ** 2 / (s ** 2).sum()
    assert (got[0].var1, got[0].var2) == (round(100 * share[0]), round(100 * share[1]))
    mean = lambda p, d: np.mean([r[d] for r in got.values() if r.party == p])
    assert mean("sd", "dim1") <= mean("kok", "dim1")
    for r in got.values():
        cs = {p: (mean(p, "dim1"), mean(p, "dim2")) for p in ("sd", "kok", "vihr")}
        d = {p: np.hypot(r.dim1 - a, r.dim2 - b) for p, (a, b) in cs.items()}
        assert r.nearest_party == min(d, key=d.get) and abs(r.dist_own - d[r.party]) < 1e-6


def test_political_map_equals_svd(spark):
    x, rec, vote, person = member_votes(spark)
    check_map(x, maps.political_map(rec, vote, person, years=(2024,), min_votes=5))
    assert maps.political_map(rec, vote, person, years=(1999,), min_votes=5) is None


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(i, f"p{i % 40}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))],
                                "person_id long, party string, dim1 double, dim2 double")
    cs = maps.centroids(pts)
    a, b = (maps.nearest_centroid(pts, cs, blocks=n).orderBy("person_id").collect() for n in (1, 7))
    assert [(r.nearest_party, round(r.dist_own, 9)) for r in a] == [(r.nearest_party, round(r.dist_own, 9)) for r in b]


def test_rhetoric_map(spark):
    rng = np.random.default_rng(7)
    vec = rng.normal(size=(60, 6))
    emb = spark.createDataFrame([(i % 12, [float(v) for v in vec[i]]) for i in range(60)], "person_id long, embedding array<float>")
    person = spark.createDataFrame([(i, ("sd", "kok", "vihr")[i % 3]) for i in range(12)], "person_id long, party_current string")
    out = {r.person_id: r for r in maps.rhetoric_map(emb, person, dim=6, min_speeches=5).collect()}
    m = np.array([vec[i::12].astype("float32").mean(axis=0) for i in range(12)])
    m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-9
    u, s, _ = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    c = u[:, 0] * s[0]
    want = 200 * (c - c.min()) / (c.max() - c.min()) - 100
    mine = np.array([out[i].dim1 for i in range(12)])
    assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-4


def test_distinctive_words_against_the_formula(spark):
    n = {("a", "x"): 40, ("a", "y"): 10, ("b", "y"): 50, ("b", "z"): 30}
    df = spark.createDataFrame([(p, w, c) for (p, w), c in n.items()], "party string, word string, n long")
    got = {(r.party, r.word): r for r in language.party_distinctive_words(df, min_party_total=1).collect()}
    total = sum(n.values())
    for p in "ab":
        ni = sum(c for (q, _), c in n.items() if q == p)
        for w in "xyz":
            yw, yi = sum(c for (_, v), c in n.items() if v == w), n.get((p, w), 0)
            a = 1000 * yw / total
            i, j = yi + a, yw - yi + a
            z = (np.log(i / (ni + 1000 - i)) - np.log(j / (total - ni + 1000 - j))) / np.sqrt(1 / i + 1 / j)
            assert abs(got[p, w].zscore - z) <= 0.005 + 1e-9 and got[p, w].n_party == yi
        assert sorted("xyz", key=lambda w: -got[p, w].zscore) == sorted("xyz", key=lambda w: got[p, w]["rank"])


def test_materialize_keeps_rows(spark):
    df = spark.range(50).withColumn("x", F.array(F.col("id")))
    assert materialize(df, "t").orderBy("id").collect() == df.orderBy("id").collect()
