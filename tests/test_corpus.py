"""Joined corpora in parts, quotes over seams, all pairs by bitmaps, changed directories."""

import itertools
import random
import shutil

import pytest
from pyspark.sql import functions as F

from votemill.operators import corpus, lines
from votemill.plans import registry
from votemill.plans.bind import BASE_TABLES
from votemill.sources import loads


def _texts(seed):
    r = random.Random(seed)
    out = []
    for bill in ("a", "b", "c", None):
        for i in range(r.randint(1, 25)):
            out.append((bill, i * 10 + len(out) % 7, r.choice(["", "x", "öö", None, "word " * r.randint(1, 60), "".join(r.choice("abc ") for _ in range(r.randint(1, 15)))])))
    return out


def _corpora(texts):
    out = {}
    for bill, _, t in sorted((x for x in texts if x[0] is not None and x[2] is not None), key=lambda x: (x[0], x[1])):
        out.setdefault(bill, []).append(t)
    return {b: " ".join(ts) for b, ts in out.items()}


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_parts_follow_each_other(spark, size):
    texts = _texts(size)
    df = spark.createDataFrame(texts, "bill string, id long, text string").where("bill is not null")
    rows = corpus.joined(df, "bill", ["id"], "text", size).orderBy("bill", "part").collect()
    want = _corpora(texts)
    assert all(len(r.text) <= size for r in rows)
    got = {b: "".join(r.text for r in rs) for b, rs in itertools.groupby(rows, key=lambda r: r.bill)}
    assert got == {b: t for b, t in want.items() if t}


def test_places_move_texts_once(spark, tmp_path):
    """Ranges and running totals are of lengths; repeated keys and groups without a name keep every text."""
    rows = [("a", 1, "long text " * 9), ("a", 1, "again"), ("a", 2, "end"), (None, 1, "first"), (None, 2, "second"), ("a", 3, None), ("b", None, "x")]
    spark.createDataFrame(rows, "bill string, id long, text string").write.parquet(str(tmp_path / "t"))
    at = corpus.placed(spark.read.parquet(str(tmp_path / "t")), "bill", ["id"], "text")
    assert {(r.bill, r.text, r.start) for r in at.collect()} == {("a", "again", 0), ("a", "long text " * 9, 6), ("a", "end", 97), (None, "first", 0), (None, "second", 6), ("b", "x", 0)}
    plan = at._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and not any("_range" in line and "text#" in line for line in plan.splitlines())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotes_over_seams(spark, seed):
    texts, r = _texts(seed), random.Random(seed)
    whole = _corpora(texts)
    quotes = set()
    for bill, t in whole.items():
        for _ in range(25):
            a = r.randrange(len(t) + 1)
            quotes.add((bill, t[a:a + r.randint(1, 40)] or "q"))
        quotes |= {(bill, t[-3:] + " "), (bill, "no such"), (bill, t[:5] + "~")}
    df = spark.createDataFrame(texts, "bill string, id long, text string")
    asked = spark.createDataFrame(sorted(quotes), "bill string, quote string")
    got = {(x.bill, x.quote) for x in corpus.across_seams(asked, df, "bill", ["id"], "text", "quote").collect()}
    held = {(b, q) for b, q in quotes if q in whole[b]}
    inside = {(b, q) for b, q in quotes if any(b == x and t is not None and q in t for x, _, t in texts)}
    assert got <= held and held - inside <= got


def test_a_claim_may_quote_across_texts(spark, seed):
    text = {x.id: x.text for x in seed.speech.collect()}
    seam = text[1][-8:] + " " + text[3][:8]  # speeches 1 and 3 are on one bill
    law = spark.createDataFrame([("HE 1/2024 vp", "t", "Esityksen sisältö", "u")], "eduskunta_tunnus string, title string, summary string, url string")
    kinds = "legislative_item string, pos int, what_changes string, who_affected string, contested string, sources array<struct<type:string,ref:string,quote:string>>, model_label string"

    def verified(*quotes):
        rows = [("HE 1/2024 vp", k, f"c{k}", "all", None, [("puhe", "s", q)], "m") for k, q in enumerate(quotes)]
        return [x.what_changes for x in loads.verified_explainers(spark.createDataFrame(rows, kinds), seed.speech, law).collect()]

    assert verified(seam) == ["c0"] and verified(text[3][-5:] + " Esityk") == ["c0"]
    assert verified(text[1][-8:] + "  " + text[3][:8]) == [] and verified(text[3][-5:] + " " + text[1][:5]) == []
    assert verified(text[1][:9], seam, "invented") == ["c1"]


def test_all_pairs_by_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(lines, "WORDS", 2)  # blocks of 128 votes
    r = random.Random(4)
    rows = [(v * 3, p, r.choice(["Jaa", "Ei", "Poissa", "Tyhjää"])) for v in range(300) for p in range(20) if r.random() < (0.02 if p == 7 else 0.8)]
    got = {(x.a, x.b): (x.agree, x.total, x.pct) for x in lines.all_pair_agreement(spark.createDataFrame(rows, "vote_id long, person_id long, vote_value string"), 20, tile=6).collect()}
    side = {(v, p): x for v, p, x in rows if x in ("Jaa", "Ei")}
    want = {}
    for a, b in itertools.combinations(range(20), 2):
        common = [side[v, a] == side[v, b] for v in range(0, 900, 3) if (v, a) in side and (v, b) in side]
        if len(common) >= 20:
            want[a, b] = (sum(common), len(common), float(round(100 * sum(common) / len(common))))
    assert got == want and not any(7 in k for k in got) and len(got) > 150


def test_a_changed_directory_gives_new_results(spark, tmp_path):
    """Written tables of a directory are not used once its files have changed."""
    small, large = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
    for t in BASE_TABLES:
        shutil.copy(f"{small}/{t}.parquet", tmp_path)
    query = registry.queries()["party_line"]
    before = query(spark, str(tmp_path)).count()
    assert query(spark, str(tmp_path)).count() == before
    for t in ("lineitem", "part", "supplier", "orders"):
        (tmp_path / f"{t}.parquet").unlink()
        shutil.copy(f"{large}/{t}.parquet", tmp_path)
    spark.catalog.clearCache()
    assert query(spark, str(tmp_path)).count() == query(spark, large).count() != before
