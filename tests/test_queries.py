import os
import shutil
import urllib.parse

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from votemill.plans.bind import Bound

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
PICK = ["party_line", "party_deviation", "topic_assign", "member_summary", "position_change", "party_distinctive_words",
        "gov_winrate", "words_votes_ledger", "promise_member_alignment", "search_bm25", "q_party_covote_matrix",
        "q_person_recent_votes", "q_words_votes_overview", "src_paged_json", "src_minutes_xml", "photo_title_resolve",
        "cache_lookup", "stream_upsert", "survey_party_stance", "win_percentile_rating"]


def test_entry(spark):
    assert entry.entry(spark).columns == ["party", "eligible", "deviations", "pct"]


def test_every_oracle_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries()) and len(entry.queries()) >= 150


@pytest.mark.parametrize("name", PICK)
def test_matches_sql(spark, name):
    msg, _ = compare(entry.queries()[name](spark, SF), connect(SF), SQL[name])
    assert msg == ""


def test_scan_is_pruned_and_filtered(spark):
    plan = entry.queries()["src_filter_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,5-LOW)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in plan


def test_topic_classification_needs_no_exchange(spark):
    from votemill.operators import topics
    df = topics.assign_topics(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("gone", [1, None])
def test_written_tables_that_are_gone_are_written_anew(spark, tmp_path, gone):
    """The run's folder may lose files between two queries, as to a job that frees disk."""
    sf = str(shutil.copytree(SF, tmp_path / "tables"))  # a model of its own
    names = ["agg_conditional", "agg_majority", "gov_lost", "fn_label_speaker", "join_anti", "search_term_statistics"]
    model = Bound.over(spark, sf)
    kept = [model.vote_record, model.party_line, model.outcomes, model.speech, model.search_index.blocks()]
    for frame in kept:
        for file in frame.inputFiles()[:gone]:
            os.remove(urllib.parse.urlparse(file).path)
    for name in names:
        assert compare(entry.queries()[name](spark, sf), connect(SF), SQL[name])[0] == "", name


def test_written_tables_serve_later_queries(spark, tmp_path):
    sf = str(shutil.copytree(SF, tmp_path / "tables"))
    first = Bound.over(spark, sf).vote_record.inputFiles()
    assert first and sorted(Bound.over(spark, sf).vote_record.inputFiles()) == sorted(first)
