"""Fingerprints and links against plain versions."""

import random
from collections import Counter

import pytest

import brute
from brute import NASTY
from votemill.llm import queries, simhash


def test_op12_on_awkward_rows(spark, nasty):
    values = [brute.simhash(t) for _, t in NASTY]
    classes, least = brute.near(values), {}
    for c, (i, _) in zip(classes, NASTY):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = Counter((i, f"{v:016x}", least[c]) for (i, _), v, c in zip(NASTY, values, classes))
    got = queries.op12_simhash(spark, nasty).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_long_texts_in_lots(monkeypatch):
    text = " ".join(f"W{k % 997}" for k in range(5000))
    monkeypatch.setattr(simhash, "LOT", 64)
    assert simhash.fingerprint(text.encode()) == brute.simhash(text)


def _values():
    """Random values, chains of links, pairs at just 4 and 5 bits, and dense families around a centre."""
    r = random.Random(3)
    flip = lambda v, bits: v ^ sum(1 << b for b in bits)
    out = [0, (1 << 64) - 1] + [r.getrandbits(64) for _ in range(300)]
    for _ in range(60):
        v = r.getrandbits(64)
        out += [v, flip(v, r.sample(range(64), 4))]
        v = r.getrandbits(64)
        out += [v, flip(v, r.sample(range(64), 5))]
        low = r.randrange(60)
        v = r.getrandbits(64)
        out += [v, flip(v, range(low, low + 4))]  # all in one segment
    v = r.getrandbits(64)
    for _ in range(30):
        v = flip(v, r.sample(range(64), 4))
        out.append(v)
    for _ in range(3):
        v = r.getrandbits(64)
        out += [flip(v, r.sample(range(64), r.randint(1, 7))) for _ in range(150)]
    return sorted(set(out))


@pytest.fixture(scope="module")
def values():
    out = _values()
    return out, brute.near(out)


@pytest.mark.parametrize("segments, light", [(2, 64), (3, 64), (4, 64), (5, 64), (3, 1), (4, 5), (None, 20)])
def test_links_by_any_plan(spark, values, segments, light):
    found, classes = values
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in found], "fp long")
    got = {r.node % (1 << 64): r.comp for r in simhash.links(prints, simhash.Settings(segments=segments, light=light)).collect()}
    want = Counter(classes)
    assert set(got) == {v for v, c in zip(found, classes) if want[c] > 1}
    assert len({(c, got[v]) for v, c in zip(found, classes) if v in got}) == len({c for c in classes if want[c] > 1}) == len(set(got.values()))


def test_radii_leave_no_pair_out():
    for m in range(2, 6):
        cut = simhash._cut(m, 4)
        assert sum(s.width for s in cut) == 64 and sum(s.radius for s in cut) == 4 - m + 1 and min(s.radius for s in cut) >= 0
        assert [s.shift for s in cut[1:]] == [s.shift + s.width for s in cut[:-1]]
    small, large = simhash.plan(1000), simhash.plan(10 ** 11)
    assert len(small) > len(large)  # more fingerprints, longer segments


def test_no_row_per_pair_of_a_family(spark):
    """A dense family of n members: its rows grow with n, not with its square."""
    r = random.Random(5)
    v = r.getrandbits(63)
    family = sorted({v ^ sum(1 << b for b in r.sample(range(63), 2)) for _ in range(900)})
    prints = spark.createDataFrame([(x,) for x in family], "fp long")
    segments = simhash.plan(len(family), simhash.Settings(segments=3))
    held, sought = simhash._tables(prints, segments)
    crowded = held.groupBy("slot").count().where("count > 8").select("slot")
    light = simhash._met(held.join(crowded, "slot", "left_anti"), sought, segments, simhash.Settings())
    assert light.count() < len(family) ** 2 / 16  # at most 8 for each of its lookups
    assert len({r.comp for r in simhash.links(prints, simhash.Settings(segments=3, light=8)).collect()}) == 1
