"""The ordered batch: every analysis table written once, later steps reading what earlier ones wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame

from votemill import constants as C
from votemill.operators import coverage, language, lines, maps, members, power, search, topics
from votemill.sources.sinks import rebuild


def run_all(facts: dict[str, DataFrame], path: str, *, period: str = "all", lexicon=None, periods=None,
            stopwords=None, style=None, map_years=(2023, 2024), map_groups: dict | None = None,
            fallback: str = C.FALLBACK_TOPIC, min_party_total: int = C.WORDS_MIN_PARTY_TOTAL,
            min_power_votes: int = 30, min_map_votes: int = 100, embedding_dim: int = 384,
            min_embedded_speeches: int = 20) -> dict[str, DataFrame]:
    """Runs the batch into ``path`` and returns the tables as read back.

    Each table replaces its last version, so a run can be repeated.
    """
    person, vote, speech = facts["person"], facts["vote"], facts["speech"]
    spark = person.sparkSession
    lexicon = lexicon or topics.default_lexicon()
    done: dict[str, DataFrame] = {}

    def save(name: str, df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        rebuild(df, f"{path}/{name}")
        done[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        return done[name]

    # facts that are views over raw rows are settled once
    vote_record = save("vote_record", facts["vote_record"])
    vote = save("vote", vote)
    search.build_index(speech, "id", "text", f"{path}/speech_index")
    topic, keyword = topics.topic_tables(spark, lexicon)
    save("topic", topic)
    save("topic_keyword", keyword)
    s_topic = save("speech_topic", topics.assign_topics(speech, "id", "text", lexicon, fallback=fallback)
                   .withColumnRenamed("id", "speech_id"))
    v_topic = save("vote_topic", topics.assign_topics(
        topics.vote_texts(vote, facts["legislation"]), "vote_id", "text", lexicon, fallback=fallback))
    line = save("party_line", lines.party_line(vote_record, vote))
    deviation = save("party_deviation", lines.party_deviation(vote_record, vote, line))
    days = members.topic_days(speech, s_topic, vote_record, vote, v_topic)
    save("member_summary", members.member_summary(person, vote_record, vote, speech, days, deviation=deviation, period=period))
    save("member_topic", members.member_topic_counts(person, speech, s_topic, vote_record, v_topic))
    save("position_change", members.position_changes(vote_record, vote, v_topic))
    counts = save("party_token", language.party_token_counts(speech, stopwords))
    save("party_words", language.party_distinctive_words(counts, min_party_total=min_party_total))
    styled = save("style_count", language.style_counts(speech, style))
    save("word_usage", language.word_style(styled, person, style))
    save("word_hits", language.top_style_words(language.style_hits(styled), person))
    outcomes = power.line_outcomes(line, vote, periods)
    save("power_effect", power.power_effect(outcomes, min_power_votes))
    coalition = save("coalition_vote", power.coalition_votes(outcomes))
    save("gov_winrate", power.coalition_winrate(coalition))
    save("gov_lost", power.coalition_lost(coalition))
    groups = map_groups or {}
    save("political_map", maps.political_map(vote_record, vote, person, years=map_years, min_votes=min_map_votes, **groups))
    if facts.get("embedding") is not None:
        save("rhetoric_map", maps.rhetoric_map(facts["embedding"], person, dim=embedding_dim,
                                               min_speeches=min_embedded_speeches, **groups))
    fallback_id = next(i for i, s, _, _ in lexicon if s == fallback)
    save("coverage_stat", coverage.coverage_stats(
        {"persons": person, "votes": vote, "vote_records": vote_record, "speeches": speech, "promises": facts["promise"]},
        s_topic, v_topic, fallback_id))
    return done
