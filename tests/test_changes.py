"""Tables kept in step with loads: equal to a full run, reading only what a load touches, complete after a break."""

import pytest
from pyspark.sql import functions as F

from votemill.operators import lines, members, topics
from votemill.plans.changes import MemberTables
from votemill.sources.keyed import KeyedTable


def _same(a, b):
    key = lambda r: repr(r)
    b = b.select(*a.columns)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def _check(got, person, record, vote, speech, s_topic, v_topic):
    days = members.topic_days(speech, s_topic, record, vote, v_topic)
    _same(lines.party_line(record, vote), got.party_line())
    _same(lines.party_deviation(record, vote), got.party_deviation())
    _same(members.member_summary(person, record, vote, speech, days), got.member_summary(person))


@pytest.fixture(scope="module")
def topic_of(seed):
    return (topics.assign_topics(seed.speech, "id", "text").withColumnRenamed("id", "speech_id"),
            topics.assign_topics(topics.vote_texts(seed.vote, seed.legislation), "vote_id", "text"))


def test_loads_equal_a_full_run(spark, seed, topic_of, tmp_path):
    s_topic, v_topic = topic_of
    got = MemberTables(spark, str(tmp_path / "t"))
    # records before their header, wrong values, another group, a vote that is procedural at first
    early = seed.vote_record.withColumn("vote_value", F.when(F.col("vote_id") == 101, "Ei").otherwise(F.col("vote_value"))) \
        .withColumn("party", F.when(F.col("person_id") == 3, "x").otherwise(F.col("party"))).where("NOT (vote_id = 102 AND person_id = 5)")
    first = seed.vote.where("vote_id < 102").withColumn("is_procedural", (F.col("vote_id") == 100).cast("int"))
    got.load(1, vote_record=early, vote=first, vote_topic=v_topic, speech=seed.speech.where("id < 3").withColumn("person_id", F.lit(2).cast("long")), speech_topic=s_topic)
    _check(got, seed.person, early, first, seed.speech.where("id < 3").withColumn("person_id", F.lit(2).cast("long")), s_topic, v_topic)
    nameless = spark.createDataFrame([(102, None, "N", str(i), "sd", v) for i, v in enumerate(["Jaa", "Jaa", None])] + [(102, 1, "a", "b", None, None)], seed.vote_record.schema)
    records = seed.vote_record.where("NOT (vote_id = 102 AND person_id = 1)").unionByName(nameless)
    got.load(2, vote_record=records, vote=seed.vote, vote_topic=v_topic, speech=seed.speech, speech_topic=s_topic)
    _check(got, seed.person, records, seed.vote, seed.speech, s_topic, v_topic)
    got.load(2, vote_record=early).load(3)  # sent again, and empty
    _check(MemberTables(spark, str(tmp_path / "t")), seed.person, records, seed.vote, seed.speech, s_topic, v_topic)


def test_a_broken_load_is_completed(spark, seed, topic_of, tmp_path, monkeypatch):
    s_topic, v_topic = topic_of
    full = dict(vote_record=seed.vote_record, vote=seed.vote, vote_topic=v_topic, speech=seed.speech, speech_topic=s_topic)
    got = MemberTables(spark, str(tmp_path / "t"))
    got.load(1, vote_record=seed.vote_record.where("vote_id = 100").withColumn("vote_value", F.lit("Ei")))
    put = KeyedTable.upsert

    def breaks(self, *a, **k):
        if self.path.endswith("count"):
            raise OSError("lost")
        return put(self, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "upsert", breaks)
        with pytest.raises(OSError):
            got.load(2, **full)
    again = MemberTables(spark, str(tmp_path / "t")).load(2, **full)
    _check(again, seed.person, seed.vote_record, seed.vote, seed.speech, s_topic, v_topic)


def test_a_load_reads_the_buckets_it_touches(spark, tmp_path):
    def vote(low, high):
        return spark.range(low, high).select(F.col("id").alias("vote_id"), F.lit("2024-01-01").alias("session_date"), F.lit(0).alias("is_procedural"))

    def record(low, high):
        return spark.range(low, high).select(F.col("id").alias("vote_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")) \
            .select("vote_id", (F.col("vote_id") % 300 * 10 + F.col("k")).alias("person_id"), F.lit("f").alias("first_name"), F.lit("l").alias("last_name"),
                    F.lit("a").alias("party"), F.when(F.col("k") == 1, "Ei").otherwise("Jaa").alias("vote_value"))

    got = MemberTables(spark, str(tmp_path / "t"), bucket_rows=40)
    got.load(1, vote_record=record(0, 600), vote=vote(0, 600))
    tables = dict(got.tables)
    got.load(2, vote_record=record(600, 602).unionByName(record(5, 6).withColumn("vote_value", F.lit("Ei"))), vote=vote(600, 602))
    assert tables["record"].depth >= 5
    assert len(tables["record"].looked_up) <= 3 and len(tables["head"].looked_up) <= 3 and len(tables["count"].looked_up) <= 12
    records = record(0, 602).withColumn("vote_value", F.when(F.col("vote_id") == 5, "Ei").otherwise(F.col("vote_value")))
    _same(lines.party_deviation(records, vote(0, 602)), got.party_deviation())
    _same(lines.party_line(records, vote(0, 602)), got.party_line())
