"""Coalition and opposition: effect of power, yearly win rate, lost votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from votemill import constants as C
from votemill.functions import scalars as S

Periods = list[tuple[str, str | None, list[str]]]


def default_periods() -> Periods:
    return list(C.COALITION_PERIODS)


def coalition_at(day: Column, periods: Periods) -> Column:
    """Groups in office on an ISO day: half-open periods, the first that fits; else an empty list."""
    head = F.substring(day, 1, 10)
    empty = F.array().cast("array<string>")

    def step(otherwise, period):
        start, end, groups = period
        inside = head >= start
        if end is not None:
            inside = inside & (head < end)
        return F.when(inside, F.array(*[F.lit(g) for g in groups])).otherwise(otherwise)

    return reduce(step, reversed(periods), empty)


def decided_votes(vote: DataFrame, periods: Periods) -> DataFrame:
    """Substantive votes with a winner, and the groups in office that day."""
    return (vote.where((F.col("is_procedural") == 0) & (F.col("result_yes") != F.col("result_no")))
            .select("vote_id", "vp_year", "result_yes", "result_no",
                    F.when(F.col("result_yes") > F.col("result_no"), C.YES).otherwise(C.NO).alias("winning"),
                    coalition_at(F.col("session_date"), periods).alias("coalition")))


def line_outcomes(line: DataFrame, vote: DataFrame, periods: Periods | None = None) -> DataFrame:
    """Each group line on a decided vote with its status and whether it won."""
    periods = default_periods() if periods is None else periods
    return (line.where(S.is_substantive(F.col("line"))).join(decided_votes(vote, periods), "vote_id")
            .withColumn("in_office", F.array_contains("coalition", F.col("party")))
            .withColumn("won", (F.col("line") == F.col("winning")).cast("int")))


def _pct1(part: Column, whole: Column) -> Column:
    return F.bround(100 * part / whole, 1)


def power_effect(outcomes: DataFrame, min_votes: int = 30) -> DataFrame:
    """Share of votes a group's line was on the winning side, in and out of office."""
    return (outcomes.groupBy("party", F.when(F.col("in_office"), "gov").otherwise("opp").alias("status"))
            .agg(F.count(F.lit(1)).alias("n_votes"), F.sum("won").alias("wins"))
            .where(F.col("n_votes") >= min_votes)
            .select("party", "status", "n_votes", _pct1(F.col("wins"), F.col("n_votes")).alias("win_pct")))


def coalition_votes(outcomes: DataFrame) -> DataFrame:
    """Line of the coalition per vote: majority of its groups' lines, ties left out."""
    yes, no = F.count_if(F.col("line") == C.YES), F.count_if(F.col("line") == C.NO)
    return (outcomes.where("in_office")
            .groupBy("vote_id", "vp_year", "result_yes", "result_no", "winning")
            .agg(yes.alias("gy"), no.alias("gn")).where("gy != gn")
            .withColumn("won", (F.when(F.col("gy") > F.col("gn"), C.YES).otherwise(C.NO) == F.col("winning")).cast("int")))


def coalition_winrate(coalition: DataFrame) -> DataFrame:
    return (coalition.groupBy("vp_year").agg(F.count(F.lit(1)).alias("n_votes"), F.sum("won").alias("gov_wins"))
            .withColumn("pct", _pct1(F.col("gov_wins"), F.col("n_votes"))))


def coalition_lost(coalition: DataFrame) -> DataFrame:
    return (coalition.where("won = 0")
            .select("vote_id", F.abs(F.col("result_yes") - F.col("result_no")).alias("margin")))
