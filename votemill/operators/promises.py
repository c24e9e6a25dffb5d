"""Promises against votes: per member, per group, and members who break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from votemill import constants as C
from votemill.functions import scalars as S
from votemill.runtime import materialize

KEPT, AGAINST, UNCLEAR = C.PROMISE_KEPT, C.PROMISE_AGAINST, C.PROMISE_UNCLEAR
UNMAPPED, MIXED = C.PROMISE_UNMAPPED, C.PROMISE_MIXED


def _everyone(promises: DataFrame, members: DataFrame, salts: int = 16) -> DataFrame:
    """Each promise with each member, a result of that size; dealt over salts so that no task or row holds either list."""
    p = promises.select("promise_id", F.pmod(F.xxhash64("promise_id"), F.lit(salts)).alias("_salt"))
    m = members.select("person_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    return p.join(m, "_salt").select("promise_id", "person_id")


def member_alignment(promise: DataFrame, mapping: DataFrame, vote_record: DataFrame, person: DataFrame,
                     vote: DataFrame) -> DataFrame:
    """Every member's record on every promise that applies to them.

    A group promise applies to the members of that group (to everyone when the
    promise or the member has no group), a personal one to its person.
    """
    p = promise.select(F.col("id").alias("promise_id"), "scope", "party_code",
                       F.col("person_id").alias("promise_person"))
    m = person.select("person_id", F.col("party_current").alias("party"))
    group, own = F.col("scope") == "party", F.col("scope") == "person"
    keyed_group = group & F.col("party_code").isNotNull()
    keyed_own = own & F.col("promise_person").isNotNull()
    open_to_all = ~(keyed_group | keyed_own)
    cols = ["promise_id", "person_id"]
    # equality joins for the two keyed kinds; the unkeyed promises, and members
    # without a group, are the only ones that meet everyone
    applies = (p.where(keyed_group).join(m, F.col("party_code") == F.col("party")).select(*cols)
               .unionByName(p.where(keyed_own).withColumnRenamed("promise_person", "person_id")
                            .join(m.select("person_id"), "person_id").select(*cols)))
    applies = (applies.unionByName(_everyone(p.where(open_to_all), m))
               .unionByName(_everyone(p.where(keyed_group), m.where(F.col("party").isNull()))))
    mapped = materialize(mapping.select("promise_id", "vote_id", "expected_value").join(vote.select("vote_id"), "vote_id"), "mapped-votes")
    # only records that exist are looked at, not every vote of a promise for every member: a mapped vote
    # without a record is unclear, so these are the promise's votes less those with a record
    value, one, zero = F.col("vote_value"), F.lit(1), F.lit(0)
    record = vote_record.where(F.col("person_id").isNotNull()).select("vote_id", "person_id", "vote_value")
    again = record.groupBy("vote_id", "person_id").agg((F.count(one) - 1).alias("n")).where("n > 0")
    unclear = value.isNull() | value.isin(C.ABSENT, C.BLANK)
    kept = ~unclear & F.coalesce(value == F.col("expected_value"), F.lit(False))
    said = mapped.join(record, "vote_id").select(*cols, kept.cast("long").alias("s"), (~unclear & ~kept).cast("long").alias("c"), unclear.cast("long").alias("u"), one.cast("long").alias("seen"))
    twice = mapped.join(again, "vote_id").select(*cols, *[zero.cast("long").alias(x) for x in "scu"], (-F.col("n")).alias("seen"))
    sums = said.unionByName(twice).groupBy(*cols).agg(*[F.sum(x).alias(x) for x in ("s", "c", "u", "seen")])
    votes = mapped.groupBy("promise_id").agg(F.count(one).alias("mapped"))
    times, seen, whole = F.col("times"), F.coalesce("seen", zero), F.coalesce("mapped", zero)
    counted = (applies.groupBy(*cols).agg(F.count(one).alias("times")).join(sums, cols, "left").join(votes, "promise_id", "left")
               .select(*cols, (times * F.coalesce("s", zero)).alias("n_support"), (times * F.coalesce("c", zero)).alias("n_conflict"),
                       (times * (whole - seen + F.coalesce("u", zero))).alias("n_unclear")))
    s, c, u = F.col("n_support"), F.col("n_conflict"), F.col("n_unclear")
    return (counted.withColumn("unmapped", (s + c + u == 0).cast("int"))
            .withColumn("alignment", F.when(s + c + u == 0, UNMAPPED).when(s + c == 0, UNCLEAR)
                        .when(c == 0, KEPT).when(s == 0, AGAINST).otherwise(MIXED)))


def _party_promises(promise: DataFrame) -> DataFrame:
    return (promise.where((F.col("scope") == "party") & F.col("party_code").isNotNull())
            .select(F.col("id").alias("promise_id"), "party_code"))


def party_promise_results(promise: DataFrame, mapping: DataFrame, line: DataFrame, vote: DataFrame) -> DataFrame:
    """Per group promise: kept when at least half of its votes had the expected line."""
    sides = line.where(S.is_substantive(F.col("line"))).select("vote_id", F.col("party").alias("party_code"), "line")
    return (mapping.select("promise_id", "vote_id", "expected_value")
            .join(vote.select("vote_id"), "vote_id", "left_semi")
            .join(_party_promises(promise), "promise_id").join(sides, ["vote_id", "party_code"])
            .groupBy("promise_id", "party_code")
            .agg(F.count_if(F.col("line") == F.col("expected_value")).alias("n_met"),
                 F.count(F.lit(1)).alias("n_votes"))
            .withColumn("kept", (2 * F.col("n_met") >= F.col("n_votes")).cast("int")))


def keeping_by_party(results: DataFrame) -> DataFrame:
    kept, total = F.col("kept"), F.col("total")
    return (results.groupBy("party_code").agg(F.sum("kept").alias("kept"), F.count(F.lit(1)).alias("total"))
            .select(F.col("party_code").alias("party"), "kept", (total - kept).alias("broken"), "total",
                    F.bround(100 * kept / total, 0).alias("keep_pct")))


def breakers(promise: DataFrame, mapping: DataFrame, vote_record: DataFrame, person: DataFrame,
             min_eval: int = 3) -> DataFrame:
    """Members by share of own-group promises they mostly voted against (more than half)."""
    rec = (vote_record.where(S.is_substantive(F.col("vote_value")))
           .select("vote_id", "person_id", F.col("party").alias("party_code"), "vote_value"))
    per_promise = (mapping.select("promise_id", "vote_id", "expected_value")
                   .join(_party_promises(promise), "promise_id").join(rec, ["vote_id", "party_code"])
                   .groupBy("person_id", "promise_id")
                   .agg(F.count_if(F.col("vote_value") != F.col("expected_value")).alias("a"),
                        F.count(F.lit(1)).alias("n")))
    return (per_promise.groupBy("person_id")
            .agg(F.count_if(2 * F.col("a") > F.col("n")).alias("against"), F.count(F.lit(1)).alias("eval"))
            .where(F.col("eval") >= min_eval)
            .join(person.select("person_id", "full_name", "party_current"), "person_id")
            .withColumn("rate", F.bround(100 * F.col("against") / F.col("eval"), 0)))
