"""Promises against votes: every mapped vote of a promise counts for every member, with or without a record."""

import random

from votemill.operators import promises


def test_alignment_against_plain_counting(spark):
    r = random.Random(1)
    promise = [(1, "party", "x", None), (2, "party", None, None), (3, "person", None, 4), (4, "person", None, None), (5, None, None, None),
               (6, "party", "y", None), (6, "party", "y", None), (7, "party", "x", None), (8, "person", None, 77)]  # 6 twice, 7 without votes
    person = [(p, ["x", "y", None][p % 3]) for p in range(9)] + [(3, "x"), (None, "y")]
    vote = [(v,) for v in range(30)] + [(4,)]  # a vote twice
    mapping = [(r.choice([1, 2, 3, 4, 5, 6, 8, 9]), r.choice([*range(33), None]), r.choice(["Jaa", "Ei", "Ei", None])) for _ in range(120)]
    record = [(v, p, r.choice(["Jaa", "Ei", "Poissa", "Tyhjää", "odd", None])) for v in range(32) for p in [*range(9), None] if r.random() < 0.6]
    record += record[:40] + [(v, p, "Ei") for v, p, _ in record[20:60]]
    df = spark.createDataFrame
    got = promises.member_alignment(df(promise, "id long, scope string, party_code string, person_id long"), df(mapping, "promise_id long, vote_id long, expected_value string"),
                                    df(record, "vote_id long, person_id long, vote_value string"), df(person, "person_id long, party_current string"), df(vote, "vote_id long"))
    want = {}
    for i, scope, code, own in promise:
        for p, party in person:
            keyed_group, keyed_own = scope == "party" and code is not None, scope == "person" and own is not None
            if keyed_group and party not in (code, None) or keyed_own and p != own:
                continue
            n = want.setdefault((i, p), [0, 0, 0])
            for j, v, expected in mapping:
                for _ in range(sum(v == w for w, in vote) if i == j else 0):
                    for x in [x for w, q, x in record if w == v and q == p and p is not None] or [None]:
                        n[2 if x in (None, "Poissa", "Tyhjää") else 0 if x == expected else 1] += 1
    rows = got.collect()
    assert {(x.promise_id, x.person_id): [x.n_support, x.n_conflict, x.n_unclear] for x in rows} == want and len(rows) == len(want)
    assert all(x.unmapped == (sum(want[x.promise_id, x.person_id]) == 0) for x in rows)
    # no row for every mapped vote of every member: only the sums are met with the promises
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, ((vote_id" not in plan
