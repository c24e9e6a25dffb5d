"""Lines, deviations and member summaries kept in step with loads.

A load reads itself and the groups that it touches: the votes it brings records
or a header of, and the members whose sums it changes.  Below ``path`` stand
keyed tables whose buckets follow the vote, the speech or the member:

* ``head`` (vote, date, procedural flag, topics), ``record`` (a row per vote and
  voter) and ``talk`` (member, day and topics of a speech): the newest row of each;
* ``line`` and ``deviation``: the results of each vote.  A row that a correction
  takes away stays as one without line or class, and is left out when read;
* ``count`` (member, group) and ``day`` (member, topic, day): sums.  A load adds
  what its votes and speeches give now, less what they gave before;
* ``summary``: a row per member, made anew from the sums of the members touched.

A load is first worked out whole and written to ``path/loads/<number>``, then put
into the tables, each of which knows the last load it has.  So a load that broke
off is completed by the next call, and one that is sent again changes nothing.

Records without a member are told apart by the name.  Null values, parties and
days are kept and counted as the full run counts them; an empty load is one that
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from votemill import constants as C
from votemill.functions import scalars as S
from votemill.operators import lines, members
from votemill.operators.relational import first_per_key, upsert
from votemill.runtime import materialize
from votemill.sources.keyed import KeyedTable

#: name: (columns, key, columns that the buckets follow)
TABLES = {
    "head": ("vote_id long, session_date string, is_procedural int, topics array<int>", ["vote_id"], ["vote_id"]),
    "record": ("vote_id long, who string, person_id long, party string, vote_value string", ["vote_id", "who"], ["vote_id"]),
    "talk": ("speech_id long, person_id long, day date, topics array<int>", ["speech_id"], ["speech_id"]),
    "line": ("vote_id long, party string, line string", ["vote_id", "party"], ["vote_id"]),
    "deviation": ("person_id long, vote_id long, party string, member_value string, party_line string, classification string", ["vote_id", "person_id"], ["vote_id"]),
    "count": ("person_id long, party string, n long, cast long, absent long, follows long, deviates long, n_speeches long", ["person_id", "party"], ["person_id"]),
    "day": ("person_id long, topic_id int, day date, n_votes long, n_spoke long", ["person_id", "topic_id", "day"], ["person_id"]),
    "summary": ("person_id long, period string, n_votes_total long, n_votes_eligible long, n_deviations long, deviation_rate double, n_votes_cast long, n_absent long, n_speeches long, "
                "speech_vote_alignment double, party_line_score double, consistency_index int, confidence_score double, confidence_level string, flags string", ["person_id"], ["person_id"]),
}
COUNTS, DAYS = ["n", "cast", "absent", "follows", "deviates", "n_speeches"], ["n_votes", "n_spoke"]
#: Lots that a bucket may have before it is rewritten.
MOST_LOTS = 8


class MemberTables:
    """The tables below ``path``; ``load`` takes the next load."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 1 << 16, period: str = "all"):
        self.spark, self.path, self.period = spark, path, period
        self.tables = {name: KeyedTable(spark, f"{path}/{name}", keys, bucket_rows, by) for name, (_, keys, by) in TABLES.items()}

    # --- reading -------------------------------------------------------------------------
    def _rows(self, name: str) -> DataFrame:
        table = self.tables[name]
        return table.current() if table.size else self._shaped(name, None)

    def party_line(self) -> DataFrame:
        return self._rows("line").where(F.col("line").isNotNull())

    def party_deviation(self) -> DataFrame:
        return self._rows("deviation").where(F.col("classification").isNotNull())

    def member_summary(self, person: DataFrame) -> DataFrame:
        """Of the registered members."""
        return self._rows("summary").join(person.select("person_id"), "person_id", "left_semi")

    def _shaped(self, name: str, df: DataFrame | None) -> DataFrame:
        """Rows with the columns and types of a table; none for ``None``."""
        if df is None:
            return self.spark.createDataFrame([], TABLES[name][0])
        fields = [c.strip().split(" ") for c in TABLES[name][0].split(",")]
        return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields])

    def _touched(self, name: str, rows: DataFrame) -> DataFrame:
        return self._shaped(name, self.tables[name].matching(rows))

    # --- loading -------------------------------------------------------------------------
    def load(self, number: int, *, vote_record: DataFrame | None = None, vote: DataFrame | None = None, vote_topic: DataFrame | None = None,
             speech: DataFrame | None = None, speech_topic: DataFrame | None = None) -> MemberTables:
        """The tables after load ``number`` (from 1, without gaps): its records, its headers and speeches, each with their topics."""
        last = self._last()
        if last:
            self._put(last)  # nothing to do unless the last call broke off
        if number > last:
            made = self._made(self._record_rows(vote_record), self._with_topics("head", vote, vote_topic), self._with_topics("talk", speech, speech_topic))
            _each(lambda name: made[name].write.mode("overwrite").parquet(f"{self.path}/loads/{number}/{name}"))
            self.spark.createDataFrame([(number,)], "number int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/loads/{number}/whole")
            self._put(number)
        return self

    def _last(self) -> int:
        """The last load that was written whole."""
        table = self.tables["head"]
        found = [int(n) for n in table._names(f"{self.path}/loads") if n.isdigit()]
        return max([n for n in found if "_SUCCESS" in table._names(f"{self.path}/loads/{n}/whole")], default=0)

    def _put(self, number: int) -> None:
        def put(name: str) -> None:
            rows = self.spark.read.schema(TABLES[name][0]).parquet(f"{self.path}/loads/{number}/{name}")
            table = self.tables[name].newest().upsert(rows, number)
            if any(len(lots) > MOST_LOTS for lots in table._live().values()):
                table = table.merge()
            self.tables[name] = table

        _each(put)

    def _record_rows(self, df: DataFrame | None) -> DataFrame:
        if df is None:
            return self._shaped("record", None)
        unnamed = F.concat(F.lit("?"), F.concat_ws("|", "first_name", "last_name"))
        return self._once("record", df.withColumn("who", F.coalesce(F.col("person_id").cast("string"), unnamed)))

    def _with_topics(self, name: str, df: DataFrame | None, topics: DataFrame | None) -> DataFrame:
        if df is None:
            return self._shaped(name, None)
        key = TABLES[name][1][0]
        if name == "talk":
            df = df.select(F.col("id").alias(key), "person_id", S.iso_day(F.col("started_at")).alias("day"))
        held = topics.groupBy(key).agg(F.sort_array(F.collect_set("topic_id")).alias("topics")) if topics is not None else None
        return self._once(name, df.join(held, key, "left") if held is not None else df.withColumn("topics", F.lit(None)))

    def _once(self, name: str, df: DataFrame) -> DataFrame:
        return materialize(first_per_key(self._shaped(name, df), TABLES[name][1], []), name)

    def _made(self, record: DataFrame, head: DataFrame, talk: DataFrame) -> dict[str, DataFrame]:
        """The new rows of every table."""
        votes = materialize(record.select("vote_id").union(head.select("vote_id")).distinct(), "touched-votes")
        old = {"record": self._touched("record", votes), "head": self._touched("head", votes), "talk": self._touched("talk", talk)}
        old = {name: materialize(rows, f"old-{name}") for name, rows in old.items()}
        new = {"record": materialize(upsert(old["record"], record, TABLES["record"][1]), "new-record"),
               "head": materialize(upsert(old["head"], head, ["vote_id"]), "new-head"), "talk": talk}
        for state in (old, new):
            state["line"] = lines.party_line(state["record"], state["head"])
            state["deviation"] = materialize(lines.party_deviation(state["record"], state["head"], state["line"]), "deviations")
        counts = materialize(_change(_counts(old), _counts(new), ["person_id", "party"], COUNTS), "count-changes")
        days = materialize(_change(_days(old), _days(new), ["person_id", "topic_id", "day"], DAYS), "day-changes")
        people = materialize(counts.select("person_id").union(days.select("person_id")).distinct(), "touched-members")
        count = materialize(_sums(self._touched("count", people).unionByName(counts), ["person_id", "party"], COUNTS), "counts")
        day = materialize(_sums(self._touched("day", people).unionByName(days), ["person_id", "topic_id", "day"], DAYS), "days")
        return {"head": head, "record": record, "talk": talk,
                **{n: self._shaped(n, _with_gone(old[n], new[n], TABLES[n][1], empty)) for n, empty in (("line", "line"), ("deviation", "classification"))},
                "count": self._shaped("count", _of_keys(count, counts, ["person_id", "party"])), "day": self._shaped("day", _of_keys(day, days, ["person_id", "topic_id", "day"])),
                "summary": self._shaped("summary", _summary(count, day, self.period))}


def _each(work: Callable[[str], None]) -> None:
    """The work of every table, some tables at a time: each is a few small jobs of its own."""
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, TABLES))


def _counts(state: dict[str, DataFrame]) -> DataFrame:
    """What the votes and speeches of a state add to the counts: rows per (member, group)."""
    value, cls, zero = F.col("vote_value"), F.col("classification"), F.lit(0)

    def flag(test: Column) -> Column:
        return F.coalesce(test.cast("long"), F.lit(0))

    known = F.col("person_id").isNotNull()
    records = state["record"].where(known).select("person_id", "party", F.lit(1).alias("n"), flag(S.is_cast(value)).alias("cast"), flag(value == C.ABSENT).alias("absent"),
                                                  zero.alias("follows"), zero.alias("deviates"), zero.alias("n_speeches"))
    classes = state["deviation"].select("person_id", "party", zero.alias("n"), zero.alias("cast"), zero.alias("absent"),
                                        flag(cls == C.FOLLOWS).alias("follows"), flag(cls == C.DEVIATES).alias("deviates"), zero.alias("n_speeches"))
    talks = state["talk"].where(known).select("person_id", F.lit(None).cast("string").alias("party"), *[zero.alias(c) for c in COUNTS[:-1]], F.lit(1).alias("n_speeches"))
    return _sums(reduce(DataFrame.unionByName, [records, classes, talks]), ["person_id", "party"], COUNTS)


def _days(state: dict[str, DataFrame]) -> DataFrame:
    """What the votes and speeches of a state add to the rows per (member, topic, day)."""
    heads = state["head"].select("vote_id", S.iso_day(F.col("session_date")).alias("day"), F.explode("topics").alias("topic_id"))
    votes = (state["record"].where(F.col("person_id").isNotNull() & (F.col("vote_value") != C.ABSENT)).join(heads, "vote_id")
             .select("person_id", "topic_id", "day", F.lit(1).alias("n_votes"), F.lit(0).alias("n_spoke")))
    talks = (state["talk"].where(F.col("person_id").isNotNull() & F.col("day").isNotNull())
             .select("person_id", F.explode("topics").alias("topic_id"), "day", F.lit(0).alias("n_votes"), F.lit(1).alias("n_spoke")))
    return _sums(votes.unionByName(talks), ["person_id", "topic_id", "day"], DAYS)


def _sums(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(v).cast("long").alias(v) for v in values])


def _change(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New sums less old ones, where they differ."""
    less = old.select(*keys, *[(-F.col(v)).alias(v) for v in values])
    return _sums(new.unionByName(less), keys, values).where(reduce(lambda a, b: a | b, [F.col(v) != 0 for v in values]))


def _of_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key stands in ``other`` (or does not: ``left_anti``); null is a value like any other."""
    right = other.select(*[F.col(k).alias(f"_other_{k}") for k in keys])
    return df.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]), how)


def _with_gone(old: DataFrame, new: DataFrame, keys: list[str], empty: str) -> DataFrame:
    """The new rows, and the old ones without a successor, with nothing in ``empty``."""
    gone = _of_keys(old, new, keys, "left_anti").withColumn(empty, F.lit(None).cast("string"))
    return new.unionByName(gone)


def _summary(count: DataFrame, day: DataFrame, period: str) -> DataFrame:
    """Summary rows of members from all their sums."""
    per = count.groupBy("person_id").agg(
        F.sum("n").alias("n_votes_total"), F.sum("cast").alias("n_votes_cast"), F.sum("absent").alias("n_absent"), F.count_if((F.col("n") > 0) & F.col("party").isNotNull()).alias("n_parties"),
        F.sum("follows").alias("follows"), F.sum("deviates").alias("deviates"), F.sum("n_speeches").alias("n_speeches"))
    spoke = day.where("n_votes > 0 OR n_spoke > 0").select("person_id", "topic_id", "day", "n_votes", (F.col("n_spoke") > 0).cast("int").alias("spoke"))
    aligned = members.speech_vote_alignment(spoke).select("person_id", "alignment")
    return members.summary_rows(per.join(aligned, "person_id", "left").where("n_votes_total > 0 OR n_speeches > 0"), period)
