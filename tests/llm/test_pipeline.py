"""The pipeline's stages on the awkward table, each against what it is given."""

from collections import Counter, defaultdict

import corpus_pipeline
import brute
from votemill.llm import queries, stages


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]


def test_stages(spark, nasty, tmp_path):
    docs = queries.documents(spark, nasty)
    toxic = Counter(r.doc_id for r in queries.op7_toxicity(spark, nasty).where("predicted = 0").collect())
    given = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, nasty).write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        before = [(r.doc_id, r.text) for r in given.collect()]
        if number < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            after = [(r.doc_id, r.text) for r in out.collect()]
            assert {tuple(r) for r in out.select("_number", "row", "id", "component").distinct().collect()} == {("_number", "row", "id", "component")}
        if number == 0:
            assert Counter(i for i, _ in after) == toxic
        elif number == 1:
            assert Counter(i for i, _ in after) == Counter(r.doc_id for r in stages.quality.judge(given, keep=["doc_id"]).where("kept").select("row.doc_id").collect())
        elif number == 2:
            groups = {c for *_, c in brute.components(before)}
            assert Counter(i for i, _ in after) == Counter(groups) and set(after) <= set(before)
        elif number == 3:
            want = Counter((i, kept.decode("utf-8", "ignore")) for i, *_, kept in brute.cut(before, stages.PASSAGE.length))
            assert Counter(after) == want
        given = out
    packed = defaultdict(list)
    for r in given.collect():
        packed[r.sequence_id].append((r.offset, r.length))
    for places in packed.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
    assert {r.doc_id for r in given.select("doc_id").distinct().collect()} == {i for i, _ in after}


def test_passages_of_over_50_words(spark):
    """A passage that two or more texts hold goes from all of them, and nothing beside it; words next to it stay."""
    passages = [brute._prose(4_000 + k, 52).replace("\n", " ") for k in range(6)]
    texts, own = [], []
    for i in range(24):
        before, after = brute._prose(5_000 + i, 40), brute._prose(6_000 + i, 30)
        texts.append((i, f"{before} {passages[i % 6]} {after}" if i < 18 else f"{before} {after}"))
        own.append((before, after))
    assert 200 < min(len(p.encode()) for p in passages) < 400
    out = {r.doc_id: r.text for r in stages.cut_repeats(spark, spark.createDataFrame(texts, "doc_id long, text string"), "").collect()}
    for i, text in texts:
        before, after = own[i]
        if i < 18:
            assert passages[i % 6] not in out[i] and len(out[i]) <= len(before) + len(after) and len(out[i]) > len(before) + len(after) - 10
        else:
            assert out[i] == text


def test_run(spark, nasty, empty):
    assert corpus_pipeline.run(spark, nasty).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, empty).collect() == []
