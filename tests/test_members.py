from pyspark.sql import functions as F

from votemill.operators import lines, members, power, promises, topics


def rows(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def topic_tables(seed):
    s = topics.assign_topics(seed.speech, "id", "text").withColumnRenamed("id", "speech_id")
    return s, topics.assign_topics(topics.vote_texts(seed.vote, seed.legislation), "vote_id", "text")


def summary(seed):
    s, v = topic_tables(seed)
    days = members.topic_days(seed.speech, s, seed.vote_record, seed.vote, v)
    return rows(members.member_summary(seed.person, seed.vote_record, seed.vote, seed.speech, days), "person_id")


def test_line_and_deviation(seed):
    line = rows(lines.party_line(seed.vote_record, seed.vote), "vote_id", "party")
    assert line[100, "kok"].line == "Jaa" and line[100, "sd"].line == "Ei"
    dev = rows(lines.party_deviation(seed.vote_record, seed.vote), "vote_id", "person_id")
    assert dev[100, 3].classification == "deviates" and dev[100, 3].party_line == "Jaa"
    assert dev[101, 5].classification == "absent"
    assert dev[100, 1].classification == "follows"


def test_unknown_value_deviates_and_tie_is_ineligible(spark, seed):
    rec = spark.createDataFrame([(100, 1, "a", "Jaa"), (100, 2, "a", None), (100, 3, "b", "Jaa"), (100, 4, "b", "Ei"), (100, 5, "c", "Tyhjää")],
                                "vote_id long, person_id long, party string, vote_value string")
    dev = rows(lines.party_deviation(rec, seed.vote), "person_id")
    assert dev[2].classification == "deviates"
    assert dev[3].classification == dev[4].classification == "ineligible" and dev[3].party_line == "TIE"
    assert dev[5].party_line == "UNDEFINED"


def test_summary(seed):
    s = summary(seed)
    assert s[3].n_votes_eligible == 3 and abs(s[3].deviation_rate - 1 / 3) < 1e-9
    assert all(r.consistency_index is None or 0 <= r.consistency_index <= 100 for r in s.values())
    assert s[1].speech_vote_alignment > 0
    assert all("LOW_SAMPLE" in r["flags"] for r in s.values())
    assert s[5].n_absent == 1 and s[5].n_votes_cast == 2


def test_position_change(seed):
    _, v = topic_tables(seed)
    (c,) = members.position_changes(seed.vote_record, seed.vote, v).collect()
    assert (c.person_id, c.from_value, c.to_value, c.gap_days) == (3, "Ei", "Jaa", 61)


def test_alignment_window_edges_and_null_dates(spark):
    days = spark.createDataFrame([(1, 1, "2024-01-01", 0, 1), (1, 1, "2024-01-31", 2, 0), (1, 1, "2024-02-01", 3, 0), (1, 1, None, 5, 0)],
                                 "person_id long, topic_id int, d string, n_votes long, spoke int").withColumn("day", F.to_date("d"))
    (r,) = members.speech_vote_alignment(days).collect()
    assert (r.n_pairs, r.n_near) == (10, 2)


def test_agreement(seed):
    line = lines.party_line(seed.vote_record, seed.vote)
    a = rows(lines.member_party_agreement(seed.vote_record, line, 1), "person_id", "party")
    assert a[1, "kok"].pct == 100
    pairs = seed.person.sparkSession.createDataFrame([(1, 3), (1, 4)], "a long, b long")
    p = rows(lines.pair_agreement(seed.vote_record, pairs), "a", "b")
    assert (p[1, 3].agree, p[1, 3].total, p[1, 3].pct) == (2, 3, 67) and p[1, 4].pct == 0
    m = rows(lines.party_covote(lines.party_deviation(seed.vote_record, seed.vote), ("kok", "sd"), 1), "party_a", "party_b")
    assert m["kok", "sd"].pct == 0 and m["sd", "kok"].total == 3


def test_promises(seed):
    line = lines.party_line(seed.vote_record, seed.vote)
    res = promises.party_promise_results(seed.promise, seed.mapping, line, seed.vote)
    assert rows(promises.keeping_by_party(res), "party")["kok"].keep_pct == 100
    al = rows(promises.member_alignment(seed.promise, seed.mapping, seed.vote_record, seed.person, seed.vote), "person_id")
    assert set(al) == {1, 2, 3} and al[3].alignment == "ristiriidassa" and al[1].alignment == "tukee"


def test_coalition_periods(spark):
    days = ["2016-01-01", "2017-06-13 10:00", "2018-01-01", "2021-01-01", "2024-01-01", "2010-01-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = [set(r.g) for r in df.select(power.coalition_at(F.col("d"), power.default_periods()).alias("g")).collect()]
    assert "ps" in got[0] and "sin" in got[1] and "ps" not in got[2] and "sd" in got[3] and "kok" in got[4] and got[5] == set()
