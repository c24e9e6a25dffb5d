"""Member table and its child tables from parsed biographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from votemill.functions import scalars as S


def load_members(rows: DataFrame, profiles: DataFrame, *, start_year: int, end_year: int,
                 only_active: bool = True, base_url: str = "") -> DataFrame:
    """Register rows ``(person_id, firstname, lastname, minister)`` with their profile.

    Active from the first start; active to is open when any term is open.
    """
    starts, ends = F.transform("terms", lambda t: t["start"]), F.transform("terms", lambda t: t["end"])
    open_end = F.exists("terms", lambda t: t["end"].isNull())
    minister = F.lower(F.col("minister").cast("string")).isin("t", "true", "1") | (F.size("minister_roles") > 0)
    terms = F.coalesce("terms", F.array().cast("array<struct<start:string,end:string>>"))
    first, last = (F.coalesce(F.trim(c), F.lit("")) for c in ("firstname", "lastname"))
    out = (rows.join(profiles, "person_id", "left").withColumn("terms", terms)
           .select("person_id", last.alias("last_name"), first.alias("first_name"),
                   F.trim(F.concat_ws(" ", first, last)).alias("full_name"), "party_current", "party_current_name",
                   F.coalesce(minister, F.lit(False)).cast("int").alias("is_minister"),
                   "birth_year", "gender", "electoral_district", "profession",
                   F.array_min(starts).alias("active_from"),
                   F.when(open_end, F.lit(None)).otherwise(F.array_max(ends)).alias("active_to"),
                   S.row_url("MemberOfParliament", "personId", F.col("person_id"), base_url).alias("source_url"),
                   "parties", "terms", "minister_roles"))
    return out.where(S.active_in(F.col("terms"), start_year, end_year)) if only_active else out


def activity_span(term: DataFrame) -> DataFrame:
    """First start and last end per person from a term table; an open term leaves the end open."""
    return term.groupBy("person_id").agg(
        F.min("start_date").alias("active_from"),
        F.when(F.bool_or(F.col("end_date").isNull()), F.lit(None)).otherwise(F.max("end_date")).alias("active_to"))


def active_members(term: DataFrame, person: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Persons with a term overlapping the years, or without any term."""
    first = F.coalesce(F.substring("start_date", 1, 4).cast("int"), F.lit(1900))
    last = F.coalesce(F.substring("end_date", 1, 4).cast("int"), F.lit(2999))
    hit = term.groupBy("person_id").agg(F.bool_or((last >= start_year) & (first <= end_year)).alias("hit"))
    return person.join(hit, "person_id", "left").where(F.coalesce("hit", F.lit(True))).drop("hit")


def child_table(members: DataFrame, column: str, renames: dict[str, str]) -> DataFrame:
    """One of the nested histories as its own table."""
    return members.select("person_id", F.inline(column)).select(
        "person_id", *[F.col(src).alias(dst) for src, dst in renames.items()])


PARTY_COLUMNS = {"code": "group_code", "name": "group_name", "start": "start_date", "end": "end_date"}
TERM_COLUMNS = {"start": "start_date", "end": "end_date"}
ROLE_COLUMNS = {"title": "title", "government": "government", "start": "start_date", "end": "end_date"}
