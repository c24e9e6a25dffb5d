"""The segmented text index against one built whole, and searches that skip against those that score everything."""

import random

import pytest
from pyspark.sql import functions as F

from votemill.operators import postings, search


def texts(n, seed=0, start=0):
    """Zipf-like words; text 7 of every 40 is long, "common" stands in nearly all of them, "hot" many times in a few."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    out = []
    for i in range(start, start + n):
        body = r.choices(words, weights, k=r.choice([3, 8, 20, 60]) if i % 40 else 400)
        if i % 50:
            body.insert(r.randrange(len(body)), "common")
        if i % 97 == 3:
            body += ["hot"] * 5 + ["red", "gear"]
        out.append((i, " ".join(body)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def rows_of(index):
    return sorted((r.term, r.doc_id, r.tf, r.doc_length, tuple(r.places)) for r in index.postings.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)


def test_loads_equal_a_full_build(spark, small, tmp_path):
    rows = dict(texts(300))
    index = postings.build(frame(spark, list(rows.items())[:120]), "id", "text", f"{tmp_path}/a")
    first = index.segments[0]
    index = index.add(frame(spark, list(rows.items())[120:300]))
    assert [p.number for p in index.segments] == [1, 2] and index.segments[0] == first
    # replaced, deleted and added again
    changed = {5: "quite another text", 130: "common common", 131: ""}
    index = index.replace(frame(spark, list(changed.items())))
    index = index.delete(frame(spark, [(7, ""), (8, ""), (9_999, "")]).select("id"))
    index = index.add(frame(spark, [(8, "back again")]))
    now = {**rows, **changed, 8: "back again"}
    now.pop(7)
    whole = postings.build(frame(spark, list(now.items())), "id", "text", f"{tmp_path}/b")
    want = rows_of(whole)
    assert rows_of(index) == want and index.totals == whole.totals
    assert {tuple(r) for r in index.term_statistics().collect()} == {tuple(r) for r in whole.term_statistics().collect()}
    for phrases in ([["w1"], ["common"], ["nowhere"], ["red", "gear"]], [["back", "again"]]):
        assert _ranked(search.bm25(index, phrases)) == _ranked(search.bm25(whole, phrases))
    small_index = index.compacted()
    assert len(small_index.parts) == 1 and rows_of(small_index) == want and small_index.totals == whole.totals
    assert rows_of(search.Index(spark, f"{tmp_path}/a")) == want


def _ranked(df):
    return sorted(((round(r.score, 9), r.id) for r in df.collect()), key=lambda x: (-x[0], x[1]))


def test_small_segments_are_merged(spark, tmp_path):
    index = postings.build(frame(spark, texts(10)), "id", "text", f"{tmp_path}/i")
    for k in range(1, 5):
        index = index.add(frame(spark, texts(10, seed=k, start=10 * k)))
        index = index.delete(frame(spark, [(10 * k, "")]).select("id"))
    assert len(index.segments) == 2 and sum(p.docs for p in index.segments) - sum(p.docs for p in index.parts if p.kind == "dead") == 46
    every = [row for k in range(5) for row in texts(10, seed=k, start=10 * k) if not (k and row[0] == 10 * k)]
    assert rows_of(index) == rows_of(postings.build(frame(spark, every), "id", "text", f"{tmp_path}/w"))


def test_a_load_reads_no_older_segment(spark, tmp_path):
    """The second load works with the first segment's postings gone."""
    index = postings.build(frame(spark, texts(20)), "id", "text", f"{tmp_path}/i")
    folder, files = postings._folder(spark, f"{index.segments[0].path}")
    files.delete(folder, True)
    index = index.add(frame(spark, texts(20, start=20)))
    assert len(index.segments) == 2 and index.blocks(segments=index.segments[1:]).count() > 0


def test_an_older_version_goes_on(spark, tmp_path):
    old = postings.build(frame(spark, texts(20)), "id", "text", f"{tmp_path}/i")
    want = rows_of(old)
    old.add(frame(spark, texts(20, start=20))).delete(frame(spark, [(3, "")]).select("id"))
    assert rows_of(old) == want and rows_of(postings.Index(spark, f"{tmp_path}/i", old.version)) == want


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Two segments in small blocks, with tombstones."""
    folder, block = str(tmp_path_factory.mktemp("index")), postings.BLOCK
    postings.BLOCK = 16
    index = postings.build(frame(spark, texts(600)), "id", "text", folder).add(frame(spark, texts(300, seed=9, start=600)))
    postings.BLOCK = block
    return index.delete(frame(spark, [(3, ""), (100, "")]).select("id"))


@pytest.mark.parametrize("phrases, require_all", [([["common"]], False), ([["common"], ["hot"]], False), ([["w0"], ["w1"], ["w2"]], True), ([["red", "gear"], ["common"]], False), ([["common"], ["nowhere"]], True)])
def test_the_best_are_those_of_the_full_scoring(spark, grown, phrases, require_all):
    index = grown
    everything = _ranked(search.bm25(index, phrases, require_all=require_all))
    for k in (2, 30):
        got = [(round(r.score, 9), r.id) for r in search.bm25_top(index, phrases, k, require_all=require_all).orderBy(*postings.best_first()).collect()]
        assert got == everything[:k]
    own = frame(spark, [(i, "") for i in range(0, 900, 7)])
    got = [r.id for r in search.bm25_top(index, phrases, 5, require_all=require_all, allowed=own).orderBy(*postings.best_first()).collect()]
    assert got == [i for _, i in everything if i % 7 == 0][:5]


def _rows_read(df):
    """Rows that the scans of a plan without exchanges gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_blocks_that_cannot_reach_are_not_read(spark, small, monkeypatch, tmp_path):
    """A common term: the second read leaves out most of its blocks, and a read of some blocks takes only their pages."""
    monkeypatch.setattr(postings, "PAGE_BLOCKS", 4)
    index = postings.build(frame(spark, texts(3000)), "id", "text", f"{tmp_path}/i")
    slots = [r.slot for r in index.blocks(["common"]).select("slot").distinct().collect()]
    scored = []
    plain = postings.Query.scores
    monkeypatch.setattr(postings.Query, "scores", lambda self, s=None, within=None: scored.extend(s or []) or plain(self, s, within))
    assert search.bm25_top(index, [["common"], ["hot"]], 5).count() == 5
    assert 0 < len(scored) < len(slots) / 2
    whole, part = _rows_read(index.blocks(["common"])), _rows_read(index.blocks(["common"], slots[:3]))
    assert part < whole / 2


def test_a_hot_term_is_spread_over_tasks(spark, small, monkeypatch, tmp_path):
    """No task of a load writes all blocks of a term that nearly every text holds."""
    monkeypatch.setattr(postings, "TASK_TOKENS", 2_000)
    index = postings.build(frame(spark, texts(2000)), "id", "text", f"{tmp_path}/i")
    files = index.blocks(["w0"]).groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()
    assert len(files) > 1 and max(r.n for r in files) < 0.8 * sum(r.n for r in files)
    assert index.blocks().agg(F.max(F.size("ids"))).first()[0] <= 3 * postings.BLOCK


def test_empty(spark, tmp_path):
    index = postings.build(frame(spark, []), "id", "text", f"{tmp_path}/i")
    assert index.postings.count() == 0 and search.bm25_top(index, [["a"]], 3).count() == 0 and search.bm25(index, []).count() == 0
    index = index.add(frame(spark, [(1, "a b"), (2, None)]))
    assert index.totals == (2, 1.0) and [r.id for r in search.bm25_top(index, [["a"]], 3).collect()] == [1]
