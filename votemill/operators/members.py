"""Per-member measures: speech-vote alignment, summary index, topic counts, position changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from votemill import constants as C
from votemill.functions import scalars as S
from votemill.operators import lines


def topic_days(speech: DataFrame, speech_topic: DataFrame, vote_record: DataFrame, vote: DataFrame,
               vote_topic: DataFrame, exclude_topics: list[int] | None = None) -> DataFrame:
    """Votes and speeches per (person, topic, day), the input of the interval join.

    Aggregated before the window, so a (person, topic) group holds at most one
    row per calendar day however many votes or speeches the person has.
    """
    st, vt = speech_topic.select("speech_id", "topic_id"), vote_topic.select("vote_id", "topic_id")
    if exclude_topics:
        st, vt = (d.where(~F.col("topic_id").isin(exclude_topics)) for d in (st, vt))
    votes = (vote_record.where(F.col("person_id").isNotNull() & (F.col("vote_value") != C.ABSENT))
             .select("vote_id", "person_id")
             .join(vote.select("vote_id", S.iso_day(F.col("session_date")).alias("day")), "vote_id")
             .join(vt, "vote_id")
             .select("person_id", "topic_id", "day", F.lit(1).alias("n"), F.lit(0).alias("spoke")))
    spoken = (speech.where(F.col("person_id").isNotNull())
              .select(F.col("id").alias("speech_id"), "person_id", S.iso_day(F.col("started_at")).alias("day"))
              .where(F.col("day").isNotNull()).join(st, "speech_id")
              .select("person_id", "topic_id", "day", F.lit(0).alias("n"), F.lit(1).alias("spoke")))
    return (votes.unionByName(spoken).groupBy("person_id", "topic_id", "day")
            .agg(F.sum("n").alias("n_votes"), F.max("spoke").alias("spoke")))


def near_speech(days: DataFrame, window_days: int = C.WINDOW_DAYS) -> DataFrame:
    """Marks (person, topic, day) rows with a speech of the same topic within the window."""
    span = (W.partitionBy("person_id", "topic_id").orderBy(F.unix_date("day"))
            .rangeBetween(-window_days, window_days))
    return days.withColumn("near", F.when(F.col("day").isNotNull(), F.max("spoke").over(span)).otherwise(F.lit(0)))


def speech_vote_alignment(days: DataFrame, window_days: int = C.WINDOW_DAYS) -> DataFrame:
    """Share of a member's (vote, topic) pairs with a same-topic speech close in time."""
    return (near_speech(days, window_days).where(F.col("n_votes") > 0).groupBy("person_id")
            .agg(F.sum("n_votes").alias("n_pairs"), F.sum(F.col("n_votes") * F.col("near")).alias("n_near"))
            .withColumn("alignment", F.col("n_near") / F.col("n_pairs")))


def active_persons(person: DataFrame, vote_record: DataFrame, speech: DataFrame) -> DataFrame:
    """Registered persons with a vote record or a speech."""
    seen = (vote_record.select("person_id").union(speech.select("person_id"))
            .where(F.col("person_id").isNotNull()).distinct())
    return seen.join(person.select("person_id"), "person_id", "left_semi")


def member_summary(person: DataFrame, vote_record: DataFrame, vote: DataFrame, speech: DataFrame,
                   days: DataFrame, *, deviation: DataFrame | None = None, period: str = "all",
                   weights: tuple[float, float] = (C.WEIGHT_ALIGNMENT, C.WEIGHT_LINE),
                   window_days: int = C.WINDOW_DAYS) -> DataFrame:
    """Counts, components, index, confidence and flags: one row per active member.

    ``days`` comes from :func:`topic_days`.
    """
    deviation = lines.party_deviation(vote_record, vote) if deviation is None else deviation
    value = F.col("vote_value")
    counts = (vote_record.where(F.col("person_id").isNotNull())
              .groupBy("person_id", "party")
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(S.is_cast(value)).alias("cast"),
                   F.count_if(value == C.ABSENT).alias("absent"))
              .groupBy("person_id")
              .agg(F.sum("n").alias("n_votes_total"), F.sum("cast").alias("n_votes_cast"),
                   F.sum("absent").alias("n_absent"), F.count("party").alias("n_parties")))
    spoken = speech.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count(F.lit(1)).alias("n_speeches"))
    base = (active_persons(person, vote_record, speech)
            .join(lines.deviation_counts(deviation), "person_id", "left")
            .join(counts, "person_id", "left").join(spoken, "person_id", "left")
            .join(speech_vote_alignment(days, window_days).select("person_id", "alignment"), "person_id", "left")
            .na.fill(0, ["follows", "deviates", "n_votes_total", "n_votes_cast", "n_absent", "n_parties", "n_speeches"]))

    return summary_rows(base, period, weights)


def summary_rows(base: DataFrame, period: str = "all", weights: tuple[float, float] = (C.WEIGHT_ALIGNMENT, C.WEIGHT_LINE)) -> DataFrame:
    """Components, index, confidence and flags from the counts and the alignment of each member."""
    eligible, a, b = F.col("n_votes_eligible"), F.col("alignment"), F.col("party_line_score")
    wa, wb = (F.lit(w) for w in weights)
    base = (base.withColumn("n_votes_eligible", F.col("follows") + F.col("deviates"))
            .withColumn("deviation_rate", F.when(eligible > 0, F.col("deviates") / eligible))
            .withColumn("party_line_score", 1 - F.col("deviation_rate"))
            .withColumn("_weight", F.when(a.isNotNull(), wa).otherwise(0.0) + F.when(b.isNotNull(), wb).otherwise(0.0))
            .withColumn("_sum", F.coalesce(wa * a, F.lit(0.0)) + F.coalesce(wb * b, F.lit(0.0)))
            .withColumn("_comps", F.when(a.isNotNull(), 1).otherwise(0) + F.when(b.isNotNull(), 1).otherwise(0))
            .withColumn("_conf", F.least(F.lit(1.0), eligible / F.lit(C.CONF_FULL_ELIGIBLE))
                        * F.least(F.lit(1.0), (F.col("n_speeches") + 1) / F.lit(C.CONF_FULL_SPEECHES))))
    level = (F.when((F.col("_conf") >= C.CONF_HIGH_MIN) & (F.col("_comps") == 2), C.CONF_HIGH)
             .when(F.col("_conf") >= C.CONF_MID_MIN, C.CONF_MID).otherwise(C.CONF_LOW))
    flags = F.concat_ws(
        ",", F.when(eligible < C.LOW_SAMPLE_BELOW, "LOW_SAMPLE"),
        F.when(F.col("_comps") < 2, "SINGLE_COMPONENT"), F.when(F.col("n_parties") > 1, "PARTY_CHANGE"))
    return base.select(
        "person_id", F.lit(period).alias("period"), "n_votes_total", "n_votes_eligible",
        F.col("deviates").alias("n_deviations"), "deviation_rate", "n_votes_cast", "n_absent", "n_speeches",
        F.round(a, 4).alias("speech_vote_alignment"), F.round(b, 4).alias("party_line_score"),
        F.when(F.col("_weight") > 0, F.bround(100 * F.col("_sum") / F.col("_weight"), 0)).cast("int").alias("consistency_index"),
        F.round("_conf", 4).alias("confidence_score"), level.alias("confidence_level"), flags.alias("flags"))


def member_topic_counts(person: DataFrame, speech: DataFrame, speech_topic: DataFrame,
                        vote_record: DataFrame, vote_topic: DataFrame) -> DataFrame:
    """Speeches and non-absent votes per (member, topic), registered members only."""
    s = (speech.where(F.col("person_id").isNotNull()).select(F.col("id").alias("speech_id"), "person_id")
         .join(speech_topic.select("speech_id", "topic_id"), "speech_id")
         .groupBy("person_id", "topic_id").agg(F.count(F.lit(1)).alias("s")))
    v = (vote_record.where(F.col("person_id").isNotNull() & (F.col("vote_value") != C.ABSENT))
         .select("person_id", "vote_id").join(vote_topic.select("vote_id", "topic_id"), "vote_id")
         .groupBy("person_id", "topic_id").agg(F.count(F.lit(1)).alias("v")))
    both = (s.select("person_id", "topic_id", "s", F.lit(0).cast("long").alias("v"))
            .unionByName(v.select("person_id", "topic_id", F.lit(0).cast("long").alias("s"), "v"))
            .groupBy("person_id", "topic_id").agg(F.sum("s").alias("n_speeches"), F.sum("v").alias("n_votes")))
    return both.join(person.select("person_id"), "person_id", "left_semi")


def position_changes(vote_record: DataFrame, vote: DataFrame, vote_topic: DataFrame,
                     min_gap_days: int = C.MIN_CHANGE_GAP_DAYS) -> DataFrame:
    """Yes/no flips of a member on the same bill and stage, at least ``min_gap_days`` apart.

    Days with both values are dropped first; what is left is one row per day,
    which bounds the window group by the calendar.
    """
    v = (lines.substantive_votes(vote)
         .select("vote_id", S.blank_to_null(F.col("legislative_item")).alias("item_base"),
                 F.coalesce("treatment_stage", F.lit("")).alias("stage"),
                 S.iso_day(F.col("session_date")).alias("day"))
         .where(F.col("item_base").isNotNull() & F.col("day").isNotNull()))
    daily = (vote_record.where(F.col("person_id").isNotNull() & S.is_substantive(F.col("vote_value")))
             .join(v, "vote_id")
             .groupBy("person_id", "item_base", "stage", "day")
             .agg(F.min("vote_value").alias("value"), F.max("vote_value").alias("_other"),
                  F.max("vote_id").alias("vote_id"))
             .where(F.col("value") == F.col("_other")))
    w = W.partitionBy("person_id", "item_base", "stage").orderBy("day")
    flips = (daily.withColumn("from_value", F.lag("value").over(w)).withColumn("from_day", F.lag("day").over(w))
             .withColumn("gap_days", F.datediff("day", "from_day"))
             .where((F.col("value") != F.col("from_value")) & (F.col("gap_days") >= min_gap_days)))
    primary = vote_topic.where(F.col("is_primary") == 1).select("vote_id", "topic_id")
    return (flips.join(primary, "vote_id", "left")
            .select("person_id", "topic_id", "item_base", "stage", "from_value",
                    F.col("from_day").cast("string").alias("from_date"), F.col("value").alias("to_value"),
                    F.col("day").cast("string").alias("to_date"), "gap_days", F.lit(C.NOTE_CHANGE).alias("note")))
