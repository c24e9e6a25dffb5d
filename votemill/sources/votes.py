"""Vote headers and member votes from landed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from votemill.functions import scalars as S, text as X
from votemill.operators.relational import first_per_key

HEADER_TEXT = ("session_date", "title", "extra_title", "main_item_title", "item_title", "treatment_title",
               "treatment_stage", "legislative_item", "legislative_item_url", "minutes_url", "url")
TITLES = ("title", "extra_title", "main_item_title", "item_title", "treatment_title")
HEADER_INT = ("vp_year", "session_number", "result_yes", "result_no", "result_empty", "result_absent", "result_total")


def vote_headers(rows: DataFrame, *, language: str = "1", hints=None) -> DataFrame:
    """Typed headers in one language, annulled votes dropped, first row per vote.

    Expects text columns plus ``language``, ``annulled``, ``main_title`` and the
    source order ``page``, ``place``.
    """
    annulled = F.coalesce(F.col("annulled"), F.lit(""))
    titles = [F.col(c) for c in ("title", "item_title", "main_title", "treatment_title")]
    flag = S.is_procedural(*titles) if hints is None else S.is_procedural(*titles, hints=hints)
    typed = (rows.where((F.col("language") == language) & annulled.isin("0", "", "None"))
             .select(S.to_int(F.col("vote_id")).alias("vote_id"), "page", "place",
                     *[S.to_int(F.col(c), "int").alias(c) for c in HEADER_INT],
                     *[X.nfc(c).alias(c) if c in TITLES else F.col(c) for c in HEADER_TEXT], flag.alias("is_procedural"))
             .where(F.col("vote_id").isNotNull()))
    return first_per_key(typed, ["vote_id"], ["page", "place"]).drop("page", "place")


def vote_records(rows: DataFrame) -> DataFrame:
    """Typed member votes, the first row of each (vote, person) kept; rows without a person all stay."""
    typed = rows.select(
        S.to_int(F.col("vote_id")).alias("vote_id"), S.to_int(F.col("person_id")).alias("person_id"), "page", "place",
        F.coalesce(F.trim("first_name"), F.lit("")).alias("first_name"),
        F.coalesce(F.trim("last_name"), F.lit("")).alias("last_name"),
        F.nullif(F.lower(F.trim("party")), F.lit("")).alias("party"),
        S.vote_value(F.col("vote_value")).alias("vote_value"))
    keyed = first_per_key(typed.where(F.col("person_id").isNotNull()), ["vote_id", "person_id"], ["page", "place"])
    return keyed.unionByName(typed.where(F.col("person_id").isNull())).drop("page", "place")
