"""Agreement of all pairs against plain counting: sparse and full votes, repeated cells, any kind of id."""

import collections
import itertools
import random

import pytest

from votemill.operators import lines


def _want(rows, least):
    by_vote, agree, total = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for v, p, x in rows:
        if None not in (v, p) and x in ("Jaa", "Ei"):
            by_vote[v].add((p, x))
    for cells in by_vote.values():
        for (p, x), (q, y) in itertools.combinations(sorted(cells), 2):
            if p != q:
                total[p, q] += 1
                agree[p, q] += x == y
    return {k: (agree[k], n) for k, n in total.items() if n >= least}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(lines, "LOT_CELLS", 700)
    monkeypatch.setattr(lines, "LOT_VOTES", 90)
    monkeypatch.setattr(lines, "WORDS", 1)
    r = random.Random(7)
    say = lambda: r.choice(["Jaa", "Ei", "Poissa"])
    rows = [(v, p, say()) for v in range(1000) for p in r.sample(range(v % 10, 200, 10), 6)]  # groups that never meet
    rows += [(v, p, say()) for v in range(1000, 1080) for p in range(200)] + [(5, None, "Jaa"), (None, 3, "Ei"), (2000, 3, "Jaa")]
    rows += rows[:500] + [(v, p, "Ei") for v, p, _ in rows[:300]]  # twice, and both a yes and a no
    if kind == "string":
        rows = [(v, None if p is None else f"m{p:03}", x) for v, p, x in rows]
    df = spark.createDataFrame(rows, f"vote_id long, person_id {kind}, vote_value string").repartition(3)
    got = lines.all_pair_agreement(df, 25, tile=30)
    assert dict(got.dtypes)["a"] == {"long": "bigint"}.get(kind, kind)
    found = got.collect()
    assert len(found) == len({(x.a, x.b) for x in found}) and {(x.a, x.b): (x.agree, x.total) for x in found} == _want(rows, 25)
    assert 1000 < len(found) < 199 * 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys=[a#" not in plan  # no row for each pair and block of votes meets an aggregate
    assert lines.all_pair_agreement(df.limit(0), 1).count() == 0
