"""What executors and their Python workers hold while the pipeline's stages follow one another."""

import functools
import gc
import weakref

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from votemill import runtime
from votemill.llm import caches, ngram_join, packing, queries, stages


class Table(dict):
    pass


def test_tables_in_a_cycle_are_freed_when_the_operator_changes():
    @functools.lru_cache
    def tables():
        out = Table()
        out["own"] = out
        return out

    caches.enter("one", tables.cache_clear)
    held = weakref.ref(tables())
    gc.disable()
    try:
        caches.enter("one", tables.cache_clear)
        assert held() is tables()
        caches.enter("two")
        assert held() is None
    finally:
        gc.enable()


@pytest.mark.parametrize("number", range(5))
def test_a_stage_sends_small_batches_to_its_workers(spark, nasty, number):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    stage = [stages.drop_toxic, stages.clean_lines, stages.one_of_each_group, stages.cut_repeats, stages.packed][number]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    stage(spark, spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string"), nasty)
    long = spark.range(0, 3_000, 1, 1).select("id", F.repeat(F.lit("words "), 1_000).alias("text"))
    found = long.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 3_000 and max(r.bytes for r in found) < 5_000_000


def test_the_join_sends_small_batches_to_its_workers(spark, nasty):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    queries.op1_ngram_join(spark, nasty)
    long = spark.range(0, 3_000, 1, 1).select("id", F.repeat(F.lit("words "), 1_000).alias("text"))
    found = long.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 3_000 and max(r.bytes for r in found) < 5_000_000


def test_groups_do_not_depend_on_the_size_of_batches(spark, monkeypatch):
    docs = [(i, brute._prose(i % 50, 150) + (" one more word" if i % 3 else "")) for i in range(200)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    found = []
    for size in ("64m", "20k"):
        monkeypatch.setattr(runtime, "WORKER_BATCH", size)
        joined = ngram_join.with_component_id(ngram_join.join(table, keep=["doc_id"]), "doc_id")
        found.append(sorted(tuple(r) for r in joined.select("row.doc_id", "n_shingles", "component_id").collect()))
    assert found[0] == found[1] == sorted(brute.components(docs))


def test_few_remembered_stretches_give_the_same_ids(spark):
    docs = spark.createDataFrame([(i, brute._prose(7_000 + i, 200)) for i in range(40)], "doc_id long, text string").repartition(1)
    many, few = ([tuple(r) for r in packing.tokenize(docs, memory=n).drop("row").collect()] for n in (packing.MEMORY, 30))
    assert many == few and len(many) >= 40


def test_bound_of_remembered_stretches_holds_for_a_tokenizer_already_in_memory():
    ids = packing._ids(public_tokenizers.path("byte_bpe_50k.json"))
    ids(brute._prose(1, 300))
    ids.values.memory = 20
    ids(brute._prose(2, 300))
    assert max(len(ids.values.first), len(ids.values.later)) <= 21
    packing._ids.cache_clear()
