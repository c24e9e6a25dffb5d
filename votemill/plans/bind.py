"""The analysis model shaped from the given TPC-H-like tables, in Spark and as SQL views.

``Bound`` gives each model table as a lazy DataFrame.  ``CTES`` says the same in
SQL for the oracle; ``with_ctes`` puts the needed ones in front of a query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from votemill import constants as C
from votemill.functions import scalars as S, text as X
from votemill.operators import language, lines, members, power, promises, search, stance, survey, topics
from votemill.operators.relational import first_per_key
from votemill.plans.changes import MemberTables
from votemill.sources import sinks
from votemill.runtime import fresh_path, listing, materialize, saved, spread, tune

Made = TypeVar("Made")

GROUPS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PERIODS = [
    ("1995-01-01", "1996-07-01", ["EUROPE", "ASIA"]),
    ("1996-07-01", "1998-01-01", ["AFRICA", "AMERICA", "MIDDLE EAST"]),
    ("1998-01-01", "2000-01-01", ["ASIA", "AMERICA"]),
    ("2000-01-01", None, ["EUROPE", "AFRICA", "MIDDLE EAST"]),
]
LEXICON = [
    (1, "english", "English", [("the", 1.0), ("of the", 2.0), ("wh", 0.5)]),
    (2, "german", "German", [("der", 1.0), ("die", 1.0), ("in den", 2.0), ("und", 0.5)]),
    (3, "french", "French", [("les", 1.0), ("de la", 2.0), ("et", 1.0), ("aux", 1.5)]),
    (4, "spanish", "Spanish", [("el", 1.0), ("que", 1.0), ("los", 1.5), ("de la", 1.0)]),
    (5, "goods", "Goods", [("widget", 2.0), ("ring", 2.0), ("red gea", 1.5)]),
    (6, "endings", "Endings", [("tion", 1.5), ("er", 0.5), ("on on", 2.0)]),
    (7, "muu", "Other", []),
]
FALLBACK_ID = 7
RADAR = ("english", "german", "french", "spanish", "goods", "endings")
STYLE = {"filler": (["the", "of", "der", "le", "en"], ["of the", "de la", "in the"]),
         "swear": (["th", "er", "la"], ["la la", "in der"])}
STOPWORDS = ["the", "and", "der", "die", "und", "les", "que"]
MARKERS = ("of the", "de la", "die der", "los ")
YEARS = tuple(range(1995, 2002))
STATEMENT_FACTORS = {f"statement number {i} of the survey": m for i, m in enumerate((1, 2, 3, 7, 11), 1)}
SURVEY_CODES = {"automobile": "auto", "building": "bld", "furniture": "furn", "machinery": "mach"}
ELECTION = "demo"

CLEAN_TITLE, CONTEXT_TITLE = "Hyväksyminen / Hylkääminen", "Mietintö / Lausumaehdotus"
BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()


def _day(n: str) -> str:
    return f"cast(date_add(date'1995-01-01', cast({n} as int)) as string)"


def written(make: Callable[[Bound, str], Made]) -> property:
    """A property that ``make`` writes below the folder it is given (see ``Bound.once``)."""
    return property(lambda self: self.once(make.__name__.replace("_", "-"), lambda path: make(self, path)), doc=make.__doc__)


class Bound:
    """Model tables over one directory of the given Parquet tables.

    Tables that several results read are written once to the run's folder and
    read back from there: records, lines, deviations, topics, summaries, style.
    What is made of them is put together anew for each query.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir.rstrip("/")
        self._made: dict[str, tuple[str, dict[str, str], object]] = {}

    def once(self, name: str, make: Callable[[str], Made]) -> Made:
        """What ``make`` writes below the folder it is given, kept for later queries; made anew if files of the folder have gone or changed since."""
        path, files, made = self._made.get(name, (None, None, None))
        if path is None or listing(self.spark, [path]) != files:
            path = fresh_path(self.spark, name)
            made = make(path)
            self._made[name] = path, listing(self.spark, [path]), made
        return made

    _open: dict[tuple[str, str], tuple[dict[str, str], Bound]] = {}

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> Bound:
        """The one model of this application over the files of a directory, so that its written tables serve every query.

        A file that is new, gone or changed (length or time) makes a new model, whose tables are written anew.
        """
        key, files = (spark.sparkContext.applicationId, sf_dir.rstrip("/")), listing(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in BASE_TABLES])
        if key not in cls._open or cls._open[key][0] != files:
            cls._open[key] = (files, cls(spark, sf_dir))
        return cls._open[key][1]

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- facts ---------------------------------------------------------------
    @cached_property
    def party_of(self) -> DataFrame:
        n, r = self.base("nation"), self.base("region")
        return (self.base("supplier").join(n, F.col("s_nationkey") == n["n_nationkey"])
                .join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "s_name", "n_name", "r_name"))

    @cached_property
    def person(self) -> DataFrame:
        return self.party_of.selectExpr(
            "s_suppkey AS person_id", "split(s_name, '#')[0] AS first_name", "split(s_name, '#')[1] AS last_name",
            "s_name AS full_name", "r_name AS party_current", "r_name AS party_current_name",
            "n_name AS electoral_district", "cast(s_suppkey % 20 = 0 as int) AS is_minister",
            "concat(cast(1980 + s_suppkey % 45 as string), '-01-01') AS active_from")

    @cached_property
    def raw_record(self) -> DataFrame:
        """One row per line item: repeated (vote, person) pairs, values still coded."""
        value = ("CASE WHEN l_returnflag = 'R' THEN 'Jaa' WHEN l_returnflag = 'A' THEN 'Ei' "
                 "WHEN l_linestatus = 'F' THEN 'Tyhjiä' ELSE 'Poissa' END AS vote_value")
        return self.base("lineitem").selectExpr(
            "l_partkey AS vote_id", "l_suppkey AS person_id", "l_orderkey AS page", "l_linenumber AS place", value)

    @written
    def vote_record(self, path: str) -> DataFrame:
        first = first_per_key(self.raw_record, ["vote_id", "person_id"], ["page", "place"])
        return saved(first.join(self.person.select("person_id", "first_name", "last_name",
                                                   F.col("party_current").alias("party")), "person_id")
                     .select("vote_id", "person_id", "first_name", "last_name", "party",
                             S.vote_value(F.col("vote_value")).alias("vote_value")), path)

    @cached_property
    def vote_head(self) -> DataFrame:
        """Vote headers without the result counts."""
        return self.base("part").selectExpr(
            "p_partkey AS vote_id", f"{_day('(p_partkey * 37) % 2500')} AS session_date",
            f"CASE p_partkey % 3 WHEN 0 THEN '{CLEAN_TITLE}' WHEN 1 THEN '{CONTEXT_TITLE}' ELSE p_name END AS title",
            "p_name AS item_title", "cast(null as string) AS main_item_title", "cast(null as string) AS treatment_title",
            "cast(null as string) AS extra_title",
            "concat('HE ', cast(p_partkey div 20 as string)) AS legislative_item",
            "concat('stage-', cast(p_partkey % 2 as string)) AS treatment_stage",
            "cast(p_size % 10 = 0 as int) AS is_procedural") \
            .withColumn("vp_year", F.substring("session_date", 1, 4).cast("int"))

    @written
    def vote(self, path: str) -> DataFrame:
        """Vote headers with the result counts, taken from the records."""
        v = F.col("vote_value")
        tally = self.vote_record.groupBy("vote_id").agg(
            F.count_if(v == "Jaa").alias("result_yes"), F.count_if(v == "Ei").alias("result_no"),
            F.count_if(v == "Tyhjää").alias("result_empty"), F.count_if(v == "Poissa").alias("result_absent"),
            F.count(F.lit(1)).alias("result_total"))
        filled = self.vote_head.join(tally, "vote_id", "left").na.fill(0, ["result_yes", "result_no", "result_empty", "result_absent", "result_total"])
        return saved(filled, path)

    @property
    def speech_text(self) -> DataFrame:
        return self.speech.select("id", "text")

    @written
    def speech(self, path: str) -> DataFrame:
        n = self.base("supplier").agg(F.count(F.lit(1))).scalar()
        s = spread(self.base("documents")).withColumn("text", X.nfc(F.col("text"))).withColumn("person_id", F.col("doc_id") * 7 % n).selectExpr(
            "doc_id AS id", "person_id", "concat('s', cast(doc_id as string)) AS external_key",
            f"{_day('(doc_id * 53) % 2500')} AS started_at",
            "concat('HE ', cast(doc_id div 10 as string)) AS legislative_item",
            "concat('PTK ', cast(doc_id % 180 as string), '/2020 vp') AS ptk_id", "lang AS speech_type", "text")
        # written, so that Spark sees how small it is before it deals out the texts
        who = materialize(self.person.select("person_id", "first_name", "last_name", F.col("party_current").alias("party")), "speakers")
        return saved(s.join(who, "person_id", "left").withColumn("word_count", X.word_count(F.col("text"))), path)

    @cached_property
    def ingest_state(self) -> DataFrame:
        """Progress of a load job per order year, from its update log."""
        log = self.base("orders").selectExpr("concat('votes:', year(o_orderdate)) AS job", "o_orderkey AS seq", "cast(null as string) AS last_pk", "cast(null as int) AS last_page",
                                             "CASE WHEN o_orderstatus = 'F' THEN 'done' END AS status", "o_custkey AS n_items", "cast(null as string) AS note")
        return sinks.progress_state(log)

    @written
    def search_index(self, path: str) -> search.Index:
        return search.build_index(self.speech, "id", "text", path)

    @cached_property
    def legislation(self) -> DataFrame:
        title = self.base("part").groupBy(F.expr("concat('HE ', cast(p_partkey div 20 as string))").alias("eduskunta_tunnus")) \
            .agg(F.min("p_name").alias("title"))
        text = self.base("documents").groupBy(F.expr("concat('HE ', cast(doc_id div 10 as string))").alias("eduskunta_tunnus")) \
            .agg(F.min_by("text", "doc_id").alias("summary"))
        return title.join(text, "eduskunta_tunnus", "left").withColumn("url", F.concat(F.lit("u/"), "eduskunta_tunnus"))

    @property
    def stance(self) -> DataFrame:
        s = self.base("labels").join(self.speech, F.col("doc_id") == F.col("id")).selectExpr(
            "doc_id AS id", "doc_id AS speech_id", "person_id", "legislative_item",
            "concat('p', cast(doc_id % 3 as string)) AS proposition",
            "CASE WHEN quality = 0 THEN 'vastaan' WHEN toxic = 1 THEN 'ehdollinen' "
            "WHEN doc_id % 11 = 0 THEN 'ei_kantaa' ELSE 'puolesta' END AS stance",
            "cast(null as string) AS conditional_note", "substring(text, cast(length(text) div 2 as int) + 1, 40) AS evidence_quote",
            "cast((doc_id * 17) % 100 as double) / 100 AS confidence", "'demo' AS model")
        return s

    @cached_property
    def promise(self) -> DataFrame:
        return self.base("region").selectExpr("r_regionkey", "r_name", "explode(sequence(0, 4)) AS k").selectExpr(
            "cast(r_regionkey * 5 + k as bigint) AS id",
            "CASE WHEN k = 4 THEN 'person' ELSE 'party' END AS scope",
            "CASE WHEN k = 4 THEN null ELSE r_name END AS party_code",
            "CASE WHEN k = 4 AND r_regionkey < 3 THEN cast(r_regionkey as bigint) END AS person_id",
            "concat('promise ', cast(r_regionkey * 5 + k as string)) AS text")

    @cached_property
    def promise_vote_map(self) -> DataFrame:
        return self.base("part").selectExpr(
            "cast(p_partkey % 25 as bigint) AS promise_id", "p_partkey AS vote_id",
            "CASE WHEN (p_partkey div 40) % 2 = 0 THEN 'Jaa' ELSE 'Ei' END AS expected_value",
            "concat('because of ', p_name) AS rationale", "CASE WHEN p_partkey % 3 = 0 THEN p_type END AS source_note", "p_brand AS curated_by", "'1' AS mapping_version")

    @property
    def person_term(self) -> DataFrame:
        d = self.vote_record.join(self.vote_head.select("vote_id", "session_date", "vp_year"), "vote_id")
        return d.groupBy("person_id", "vp_year").agg(F.min("session_date").alias("start_date"), F.max("session_date").alias("e")) \
            .selectExpr("person_id", "start_date", "CASE WHEN vp_year = 2001 AND person_id % 3 = 0 THEN null ELSE e END AS end_date")

    @property
    def person_party(self) -> DataFrame:
        d = self.vote_record.join(self.vote_head.select("vote_id", "session_date"), "vote_id")
        return d.groupBy("person_id", "party").agg(F.min("session_date").alias("start_date")).selectExpr(
            "person_id", "party AS group_code", "party AS group_name", "start_date", "cast(null as string) AS end_date")

    @cached_property
    def person_role(self) -> DataFrame:
        return self.person.where("is_minister = 1").selectExpr(
            "person_id", "'ministeri' AS title", "'hallitus' AS government", "active_from AS start_date", "cast(null as string) AS end_date")

    @cached_property
    def survey_wide(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_mktsegment").alias("puolue"),
            *[F.when(F.col("c_custkey") % 13 == 0, "-").otherwise((1 + (F.col("c_custkey") * m) % 5).cast("string")).alias(c)
              for c, m in STATEMENT_FACTORS.items()])

    @cached_property
    def embedding(self) -> DataFrame:
        e = self.base("embeddings")
        n = e.agg(F.floor(F.count(F.lit(1)) / 20)).scalar()
        return e.select("vec_id", (F.col("vec_id") % n).cast("long").alias("person_id"), "embedding")

    # --- derived -------------------------------------------------------------
    @cached_property
    def topic(self) -> DataFrame:
        return topics.topic_tables(self.spark, LEXICON)[0]

    @written
    def speech_topic(self, path: str) -> DataFrame:
        t = topics.assign_topics(self.speech_text, "id", "text", LEXICON).withColumnRenamed("id", "speech_id")
        return saved(t, path)

    @written
    def vote_topic(self, path: str) -> DataFrame:
        t = topics.assign_topics(topics.vote_texts(self.vote_head, self.legislation), "vote_id", "text", LEXICON)
        return saved(t, path)

    @written
    def party_line(self, path: str) -> DataFrame:
        return saved(lines.party_line(self.vote_record, self.vote_head), path)

    @written
    def party_deviation(self, path: str) -> DataFrame:
        return saved(lines.party_deviation(self.vote_record, self.vote_head, self.party_line), path)

    @property
    def topic_days(self) -> DataFrame:
        return members.topic_days(self.speech, self.speech_topic, self.vote_record, self.vote_head, self.vote_topic)

    @written
    def member_summary(self, path: str) -> DataFrame:
        return saved(members.member_summary(self.person, self.vote_record, self.vote_head, self.speech, self.topic_days,
                                            deviation=self.party_deviation), path)

    @written
    def by_loads(self, path: str) -> MemberTables:
        """Lines, deviations and summaries from two loads: votes of the even years, some with values to be corrected; then the others, the corrections and the speeches."""
        even = F.col("vp_year") % 2 == 0
        early, late = self.vote_head.where(even), self.vote_head.where(~even)
        record = self.vote_record.join(self.vote_head.select("vote_id", "vp_year"), "vote_id")
        wrong = even & (F.col("vote_id") % 5 == 0)
        first = record.where(even).withColumn("vote_value", F.when(wrong, "Ei").otherwise(F.col("vote_value")))
        return (MemberTables(self.spark, path)
                .load(1, vote_record=first, vote=early, vote_topic=self.vote_topic)
                .load(2, vote_record=record.where(wrong | ~even), vote=late, vote_topic=self.vote_topic, speech=self.speech, speech_topic=self.speech_topic))

    @written
    def member_topic(self, path: str) -> DataFrame:
        return saved(members.member_topic_counts(self.person, self.speech, self.speech_topic, self.vote_record, self.vote_topic), path)

    @written
    def position_change(self, path: str) -> DataFrame:
        return saved(members.position_changes(self.vote_record, self.vote_head, self.vote_topic), path)

    @written
    def outcomes(self, path: str) -> DataFrame:
        return saved(power.line_outcomes(self.party_line, self.vote, PERIODS), path)

    @written
    def party_words(self, path: str) -> DataFrame:
        counts = materialize(language.party_token_counts(self.speech, STOPWORDS), "party-token")
        return saved(language.party_distinctive_words(counts, min_party_total=1000), path)

    @written
    def style_counts(self, path: str) -> DataFrame:
        return saved(language.style_counts(self.speech, STYLE), path)

    @written
    def word_usage(self, path: str) -> DataFrame:
        return saved(language.word_style(self.style_counts, self.person, STYLE), path)

    @written
    def word_hits(self, path: str) -> DataFrame:
        return saved(language.top_style_words(language.style_hits(self.style_counts), self.person), path)

    @written
    def words_votes(self, path: str) -> DataFrame:
        return saved(stance.words_votes_ledger(self.stance, self.speech, self.vote_head, self.vote_record), path)

    @written
    def breakers(self, path: str) -> DataFrame:
        return saved(promises.breakers(self.promise, self.promise_vote_map, self.vote_record, self.person), path)

    @cached_property
    def survey_stance(self) -> DataFrame:
        ids = {c: i for i, c in enumerate(STATEMENT_FACTORS, 1)}
        return survey.party_stance(survey.unpivot_answers(self.survey_wide, "puolue", ids), ELECTION, SURVEY_CODES)

    @property
    def explainer(self) -> DataFrame:
        """An explainer of every bill that has speeches, quoting the last of them."""
        last = self.speech.groupBy("legislative_item").agg(F.max_by(F.struct("external_key", F.expr("right(text, 20)").alias("quote")), "id").alias("s"))
        return last.selectExpr(
            "legislative_item", "concat('changes ', legislative_item) AS what_changes", "'all' AS who_affected",
            "cast(null as string) AS contested",
            "to_json(array(named_struct('type', 'puhe', 'ref', s.external_key, 'quote', s.quote))) AS sources_json")

    @property
    def bill_arguments(self) -> DataFrame:
        """(legislative_item, first, last): speaker, group and two quotes of a bill's first and last speech."""
        one = F.struct(F.concat_ws(" ", "first_name", "last_name").alias("speaker"), "party", F.expr("substring(text, cast(length(text) div 3 as int) + 1, 20)").alias("for"),
                       F.expr("substring(text, greatest(length(text) - 30, 1), 20)").alias("against"))
        return self.speech.groupBy("legislative_item").agg(F.min_by(one, "id").alias("first"), F.max_by(one, "id").alias("last"))

    @property
    def proscons(self) -> DataFrame:
        """For and against of every vote on a bill that has speeches, out of the last of them."""
        arg = "to_json(array(named_struct('argument', '{0}', 'speaker', last.speaker, 'party', last.party, 'quote', last.{0})))"
        return (self.vote_head.select("vote_id", "legislative_item").join(self.bill_arguments, "legislative_item")
                .selectExpr("vote_id", f"{arg.format('for')} AS pro_json", f"{arg.format('against')} AS con_json", "'n' AS note"))


# --- the same model in SQL ----------------------------------------------------------
def _values(rows) -> str:
    def one(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows)


_LEX = [(i, *(k.split() + [""])[:2], w) for i, _, _, kws in LEXICON for k, w in kws]
_STYLE = [(c, *(w.split() + [""])[:2]) for c, (a, b) in STYLE.items() for w in a + b]
_PERIOD_ROWS = [(s, e or "9999", g) for s, e, gs in PERIODS for g in gs]
_TOK = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '<[^>]+>', ' ', 'g'), '[\p{L}\p{N}_-]+')"
_SEARCH_TOK = rf"regexp_extract_all(translate(regexp_replace(lower(coalesce(text, '')), '[\x{{0300}}-\x{{036F}}]+', '', 'g'), '{X.FOLD_FROM}', '{X.FOLD_TO}'), '[\p{{L}}\p{{N}}]+')"


def _sday(n: str) -> str:
    return f"cast(cast(DATE '1995-01-01' + cast({n} as int) as date) as varchar)"


CTES: dict[str, str] = {
    "person": """SELECT s_suppkey AS person_id, split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
        s_name AS full_name, r_name AS party_current, r_name AS party_current_name, n_name AS electoral_district,
        cast(s_suppkey % 20 = 0 as int) AS is_minister, cast(1980 + s_suppkey % 45 as varchar) || '-01-01' AS active_from
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "vote_record": """SELECT vote_id, person_id, first_name, last_name, party_current AS party, vote_value FROM (
        SELECT l_partkey AS vote_id, l_suppkey AS pid, CASE WHEN l_returnflag = 'R' THEN 'Jaa' WHEN l_returnflag = 'A' THEN 'Ei'
          WHEN l_linestatus = 'F' THEN 'Tyhjää' ELSE 'Poissa' END AS vote_value,
          row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber,
            CASE WHEN l_returnflag = 'R' THEN 'Jaa' WHEN l_returnflag = 'A' THEN 'Ei' WHEN l_linestatus = 'F' THEN 'Tyhjiä' ELSE 'Poissa' END) AS rn
        FROM lineitem) JOIN person ON person_id = pid WHERE rn = 1""",
    "vote": f"""SELECT p_partkey AS vote_id, {_sday('(p_partkey * 37) % 2500')} AS session_date,
        CASE p_partkey % 3 WHEN 0 THEN '{CLEAN_TITLE}' WHEN 1 THEN '{CONTEXT_TITLE}' ELSE p_name END AS title,
        p_name AS item_title, 'HE ' || (p_partkey // 20) AS legislative_item, 'stage-' || (p_partkey % 2) AS treatment_stage,
        cast(p_size % 10 = 0 as int) AS is_procedural,
        cast(substr({_sday('(p_partkey * 37) % 2500')}, 1, 4) as int) AS vp_year,
        coalesce(ry, 0) AS result_yes, coalesce(rn, 0) AS result_no, coalesce(re, 0) AS result_empty, coalesce(ra, 0) AS result_absent, coalesce(rt, 0) AS result_total
        FROM part LEFT JOIN (SELECT vote_id, count(*) FILTER (vote_value = 'Jaa') AS ry, count(*) FILTER (vote_value = 'Ei') AS rn,
          count(*) FILTER (vote_value = 'Tyhjää') AS re, count(*) FILTER (vote_value = 'Poissa') AS ra, count(*) AS rt
          FROM vote_record GROUP BY vote_id) t ON t.vote_id = p_partkey""",
    "speech": f"""SELECT doc_id AS id, (doc_id * 7) % (SELECT count(*) FROM supplier) AS person_id, 's' || doc_id AS external_key,
        {_sday('(doc_id * 53) % 2500')} AS started_at, 'HE ' || (doc_id // 10) AS legislative_item,
        'PTK ' || (doc_id % 180) || '/2020 vp' AS ptk_id, lang AS speech_type, nfc_normalize(text) AS text, first_name, last_name, party_current AS party,
        cast(len(regexp_extract_all(nfc_normalize(text), '\\S+')) as int) AS word_count
        FROM documents LEFT JOIN person p ON p.person_id = (doc_id * 7) % (SELECT count(*) FROM supplier)""",
    "legislation": """SELECT eduskunta_tunnus, title, summary, 'u/' || eduskunta_tunnus AS url FROM
        (SELECT 'HE ' || (p_partkey // 20) AS eduskunta_tunnus, min(p_name) AS title FROM part GROUP BY 1)
        LEFT JOIN (SELECT 'HE ' || (doc_id // 10) AS eduskunta_tunnus, arg_min(text, doc_id) AS summary FROM documents GROUP BY 1) USING (eduskunta_tunnus)""",
    "stance": """SELECT d.doc_id AS id, d.doc_id AS speech_id, person_id, legislative_item, 'p' || (d.doc_id % 3) AS proposition,
        CASE WHEN quality = 0 THEN 'vastaan' WHEN toxic = 1 THEN 'ehdollinen' WHEN d.doc_id % 11 = 0 THEN 'ei_kantaa' ELSE 'puolesta' END AS stance,
        substr(text, length(text) // 2 + 1, 40) AS evidence_quote, cast((d.doc_id * 17) % 100 as double) / 100 AS confidence, 'demo' AS model
        FROM labels d JOIN speech s ON s.id = d.doc_id""",
    "promise": """SELECT cast(r_regionkey * 5 + k as bigint) AS id, CASE WHEN k = 4 THEN 'person' ELSE 'party' END AS scope,
        CASE WHEN k = 4 THEN NULL ELSE r_name END AS party_code,
        CASE WHEN k = 4 AND r_regionkey < 3 THEN cast(r_regionkey as bigint) END AS person_id, 'promise ' || (r_regionkey * 5 + k) AS text
        FROM region, range(5) t(k)""",
    "promise_vote_map": """SELECT cast(p_partkey % 25 as bigint) AS promise_id, p_partkey AS vote_id,
        CASE WHEN (p_partkey // 40) % 2 = 0 THEN 'Jaa' ELSE 'Ei' END AS expected_value, 'because of ' || p_name AS rationale,
        CASE WHEN p_partkey % 3 = 0 THEN p_type END AS source_note, p_brand AS curated_by, '1' AS mapping_version FROM part""",
    "person_term": """SELECT person_id, min(session_date) AS start_date,
        CASE WHEN vp_year = 2001 AND person_id % 3 = 0 THEN NULL ELSE max(session_date) END AS end_date
        FROM vote_record JOIN vote USING (vote_id) GROUP BY person_id, vp_year""",
    "person_party": """SELECT person_id, party AS group_code, party AS group_name, min(session_date) AS start_date
        FROM vote_record JOIN vote USING (vote_id) GROUP BY person_id, party""",
    "survey_long": "SELECT c_mktsegment AS party, sid AS statement_id, cast(1 + (c_custkey * m) % 5 as int) AS answer "
                   f"FROM customer, (VALUES {_values([(i, m) for i, m in enumerate(STATEMENT_FACTORS.values(), 1)])}) f(sid, m) WHERE c_custkey % 13 <> 0",
    "survey_stance": f"""SELECT '{ELECTION}' AS election, party, code AS party_code, statement_id, round_even(sum(answer) / count(*), 2) AS mean,
        count(*) AS n, round_even(100 * count(*) FILTER (answer >= 4) / count(*), 1) AS agree_pct
        FROM survey_long LEFT JOIN (VALUES {_values(SURVEY_CODES.items())}) c(name, code) ON name = lower(trim(party)) GROUP BY party, code, statement_id HAVING count(*) >= 3""",
    "topic": f"SELECT * FROM (VALUES {_values([(i, s, l) for i, s, l, _ in LEXICON])}) t(id, slug, label)",
    "topic_keyword": f"SELECT * FROM (VALUES {_values(_LEX)}) t(topic_id, p1, p2, weight)",
    "vote_text": """SELECT vote_id, concat_ws(' ', nullif(v.title, ''), nullif(item_title, ''), nullif(legislative_item, ''), nullif(l.title, ''), nullif(l.summary, '')) AS text
        FROM vote v LEFT JOIN legislation l ON l.eduskunta_tunnus = v.legislative_item""",
    "item_tokens": f"""SELECT item_type, item_id, {_TOK} AS toks FROM (SELECT 'speech' AS item_type, id AS item_id, text FROM speech
        UNION ALL SELECT 'vote', vote_id, text FROM vote_text)""",
    "item_pos": "SELECT item_type, item_id, toks[i] AS t1, toks[i + 1] AS t2 FROM (SELECT item_type, item_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM item_tokens)",
    "item_score": """SELECT item_type, item_id, topic_id, raw / sqrt(greatest(len(toks), 25)) AS score FROM (
        SELECT item_type, item_id, topic_id, sum(cast(weight as double)) AS raw FROM item_pos JOIN topic_keyword
        ON starts_with(t1, p1) AND (p2 = '' OR starts_with(coalesce(t2, ''), p2)) GROUP BY ALL) JOIN item_tokens USING (item_type, item_id)""",
    "item_rank": """SELECT *, row_number() OVER (PARTITION BY item_type, item_id ORDER BY score DESC, topic_id) AS rn FROM (
        SELECT *, max(score) OVER (PARTITION BY item_type, item_id) AS top FROM item_score) WHERE score >= 0.40 * top AND score >= 0.15""",
    "item_topic": f"""SELECT item_type, item_id, topic_id, round(score, 4) AS score, cast(rn = 1 as int) AS is_primary,
        CASE WHEN count(*) OVER (PARTITION BY item_type, item_id) > 1 THEN 'MULTI' ELSE 'SINGLE' END AS status FROM item_rank WHERE rn <= 3
        UNION ALL SELECT item_type, item_id, {FALLBACK_ID}, 0.0, 1, 'NO_MATCH' FROM item_tokens t
        WHERE NOT EXISTS (SELECT 1 FROM item_rank r WHERE r.item_type = t.item_type AND r.item_id = t.item_id)""",
    "speech_topic": "SELECT item_id AS speech_id, topic_id, score, is_primary, status FROM item_topic WHERE item_type = 'speech'",
    "vote_topic": "SELECT item_id AS vote_id, topic_id, score, is_primary, status FROM item_topic WHERE item_type = 'vote'",
    "party_line": """SELECT vote_id, party, CASE WHEN y = n THEN 'TIE' WHEN y > n THEN 'Jaa' ELSE 'Ei' END AS line FROM (
        SELECT vote_id, party, count(*) FILTER (vote_value = 'Jaa') AS y, count(*) FILTER (vote_value = 'Ei') AS n
        FROM vote_record JOIN vote USING (vote_id) WHERE is_procedural = 0 GROUP BY vote_id, party) WHERE y + n > 0""",
    "party_deviation": """SELECT person_id, vote_id, r.party, vote_value AS member_value, coalesce(line, 'UNDEFINED') AS party_line,
        CASE WHEN vote_value = 'Poissa' THEN 'absent' WHEN vote_value = 'Tyhjää' THEN 'ineligible'
        WHEN coalesce(line, 'UNDEFINED') IN ('TIE', 'UNDEFINED') THEN 'ineligible' WHEN vote_value = line THEN 'follows' ELSE 'deviates' END AS classification
        FROM vote_record r JOIN vote USING (vote_id) LEFT JOIN party_line l USING (vote_id, party) WHERE is_procedural = 0""",
    "pair_near": """SELECT r.person_id, r.vote_id, vt.topic_id, CASE WHEN EXISTS (SELECT 1 FROM speech s JOIN speech_topic st ON st.speech_id = s.id
        WHERE s.person_id = r.person_id AND st.topic_id = vt.topic_id AND abs(date_diff('day', cast(s.started_at as date), cast(v.session_date as date))) <= 30)
        THEN 1 ELSE 0 END AS near FROM vote_record r JOIN vote v USING (vote_id) JOIN vote_topic vt USING (vote_id) WHERE r.vote_value <> 'Poissa'""",
    "alignment": "SELECT person_id, count(*) AS n_pairs, cast(sum(near) as bigint) AS n_near, sum(near) / count(*) AS a FROM pair_near GROUP BY person_id",
    "member_counts": """SELECT person_id, count(*) AS n_votes_total, count(*) FILTER (vote_value IN ('Jaa', 'Ei', 'Tyhjää')) AS n_votes_cast,
        count(*) FILTER (vote_value = 'Poissa') AS n_absent, count(DISTINCT party) AS n_parties FROM vote_record GROUP BY person_id""",
    "member_base": """SELECT p.person_id, coalesce(n_votes_total, 0) AS n_votes_total, coalesce(n_votes_cast, 0) AS n_votes_cast, coalesce(n_absent, 0) AS n_absent,
        coalesce(n_parties, 0) AS n_parties, coalesce(f, 0) + coalesce(dv, 0) AS elig, coalesce(dv, 0) AS dv, coalesce(ns, 0) AS n_speeches, a,
        CASE WHEN coalesce(f, 0) + coalesce(dv, 0) > 0 THEN dv / (f + dv) END AS rate
        FROM person p LEFT JOIN member_counts USING (person_id)
        LEFT JOIN (SELECT person_id, count(*) FILTER (classification = 'follows') AS f, count(*) FILTER (classification = 'deviates') AS dv FROM party_deviation GROUP BY 1) USING (person_id)
        LEFT JOIN (SELECT person_id, count(*) AS ns FROM speech GROUP BY 1) USING (person_id) LEFT JOIN alignment USING (person_id)
        WHERE p.person_id IN (SELECT person_id FROM vote_record UNION SELECT person_id FROM speech)""",
    "member_conf": """SELECT *, 1 - rate AS b, CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN rate IS NULL THEN 0 ELSE 1 END AS comps,
        least(1.0::double, elig / 50) * least(1.0::double, (n_speeches + 1) / 20) AS conf FROM member_base""",
    "member_summary": """SELECT person_id, 'all' AS period, n_votes_total, elig AS n_votes_eligible, dv AS n_deviations, rate AS deviation_rate, n_votes_cast, n_absent, n_speeches,
        round(a, 4) AS speech_vote_alignment, round(b, 4) AS party_line_score,
        CASE WHEN comps > 0 THEN cast(round_even(100 * (coalesce(0.5::double * a, 0) + coalesce(0.5::double * b, 0)) / (comps * 0.5::double), 0) as int) END AS consistency_index,
        round(conf, 4) AS confidence_score,
        CASE WHEN conf >= 0.66 AND comps = 2 THEN 'korkea' WHEN conf >= 0.33 THEN 'kohtalainen' ELSE 'matala' END AS confidence_level,
        concat_ws(',', CASE WHEN elig < 10 THEN 'LOW_SAMPLE' END, CASE WHEN comps < 2 THEN 'SINGLE_COMPONENT' END, CASE WHEN n_parties > 1 THEN 'PARTY_CHANGE' END) AS flags
        FROM member_conf""",
    "member_topic": """SELECT person_id, topic_id, cast(sum(s) as bigint) AS n_speeches, cast(sum(v) as bigint) AS n_votes FROM (
        SELECT person_id, topic_id, 1 AS s, 0 AS v FROM speech JOIN speech_topic ON speech_id = id
        UNION ALL SELECT person_id, topic_id, 0, 1 FROM vote_record JOIN vote_topic USING (vote_id) WHERE vote_value <> 'Poissa')
        WHERE person_id IN (SELECT person_id FROM person) GROUP BY 1, 2""",
    "position_change": """SELECT person_id, topic_id, item_base, stage, from_value, from_date, to_value, to_date, gap_days FROM (
        SELECT *, lag(to_value) OVER w AS from_value, lag(to_date) OVER w AS from_date,
          cast(date_diff('day', cast(lag(to_date) OVER w as date), cast(to_date as date)) as int) AS gap_days FROM (
          SELECT person_id, legislative_item AS item_base, treatment_stage AS stage, session_date AS to_date, min(vote_value) AS to_value, max(vote_id) AS vid
          FROM vote_record JOIN vote USING (vote_id) WHERE is_procedural = 0 AND vote_value IN ('Jaa', 'Ei')
          GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT vote_value) = 1)
        WINDOW w AS (PARTITION BY person_id, item_base, stage ORDER BY to_date))
        LEFT JOIN (SELECT vote_id, topic_id FROM vote_topic WHERE is_primary = 1) ON vote_id = vid WHERE to_value <> from_value AND gap_days >= 7""",
    "period": f"SELECT * FROM (VALUES {_values(_PERIOD_ROWS)}) t(s, e, g)",
    "outcomes": """SELECT l.vote_id, l.party, l.line, v.vp_year, v.result_yes, v.result_no, CASE WHEN result_yes > result_no THEN 'Jaa' ELSE 'Ei' END AS winning,
        EXISTS (SELECT 1 FROM period p WHERE p.g = l.party AND p.s <= v.session_date AND v.session_date < p.e) AS in_office
        FROM party_line l JOIN vote v USING (vote_id) WHERE line IN ('Jaa', 'Ei') AND is_procedural = 0 AND result_yes <> result_no""",
    "coalition": """SELECT *, CASE WHEN gy > gn THEN 'Jaa' ELSE 'Ei' END = winning AS won FROM (
        SELECT vote_id, vp_year, result_yes, result_no, winning, count(*) FILTER (line = 'Jaa') AS gy, count(*) FILTER (line = 'Ei') AS gn
        FROM outcomes WHERE in_office GROUP BY ALL) WHERE gy <> gn""",
    "power_effect": """SELECT party, CASE WHEN in_office THEN 'gov' ELSE 'opp' END AS status, count(*) AS n_votes,
        round_even(100 * count(*) FILTER (line = winning) / count(*), 1) AS win_pct FROM outcomes GROUP BY 1, 2 HAVING count(*) >= 10""",
    "speech_tokens": f"SELECT id, person_id, party, {_TOK} AS toks FROM speech",
    "party_tokens": f"""SELECT party, word, count(*) AS n FROM (SELECT party, unnest(toks) AS word FROM speech_tokens WHERE party IS NOT NULL)
        WHERE length(word) >= 3 AND word NOT IN ({', '.join(repr(w) for w in STOPWORDS)}) AND NOT regexp_full_match(word, '\\p{{Nd}}+') GROUP BY 1, 2""",
    "word_scored": """SELECT party, word, yi, n_total, (ln(num_i / (ni + 1000.0::double - yi - aw)) - ln(num_j / (nn - ni + 1000.0::double - (n_total - yi) - aw))) / sqrt(1.0::double / num_i + 1.0::double / num_j) AS z FROM (
        SELECT p.party, v.word, coalesce(n, 0) AS yi, n_total, ni, nn, 1000.0::double * n_total / nn AS aw, coalesce(n, 0) + 1000.0::double * n_total / nn AS num_i,
          n_total - coalesce(n, 0) + 1000.0::double * n_total / nn AS num_j
        FROM (SELECT word, cast(sum(n) as bigint) AS n_total FROM party_tokens GROUP BY 1 HAVING sum(n) >= 30) v
        CROSS JOIN (SELECT party, cast(sum(n) as bigint) AS ni FROM party_tokens GROUP BY 1 HAVING sum(n) >= 1000) p
        CROSS JOIN (SELECT cast(sum(n) as bigint) AS nn FROM party_tokens) t LEFT JOIN party_tokens c ON c.party = p.party AND c.word = v.word)""",
    "party_words": """SELECT party, word, round(z, 2) AS zscore, yi AS n_party, n_total, cast(rn as int) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY party ORDER BY round(z, 9) DESC, word DESC) AS rn FROM word_scored) WHERE rn <= 30""",
    "style_lexicon": f"SELECT * FROM (VALUES {_values(_STYLE)}) t(category, w1, w2)",
    "speech_pos": "SELECT person_id, toks[i] AS t1, toks[i + 1] AS t2 FROM (SELECT person_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM speech_tokens)",
    "style_hits": """SELECT person_id, category, CASE WHEN w2 = '' THEN w1 ELSE w1 || ' ' || w2 END AS word, count(*) AS n
        FROM speech_pos JOIN style_lexicon ON t1 = w1 AND (w2 = '' OR t2 = w2) WHERE person_id IN (SELECT person_id FROM person) GROUP BY 1, 2, 3""",
    "word_usage": """SELECT person_id, category, coalesce(h, 0) AS n_hits, n_words, round(CASE WHEN n_words > 0 THEN 1000.0::double * coalesce(h, 0) / n_words ELSE 0 END, 3) AS per_1000
        FROM (SELECT person_id, cast(sum(len(toks)) as bigint) AS n_words FROM speech_tokens WHERE person_id IN (SELECT person_id FROM person) GROUP BY 1)
        CROSS JOIN (SELECT DISTINCT category FROM style_lexicon)
        LEFT JOIN (SELECT person_id, category, cast(sum(n) as bigint) AS h FROM style_hits GROUP BY 1, 2) USING (person_id, category)""",
    "word_hits": "SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY person_id, category ORDER BY n DESC, word) as int) AS rank FROM style_hits) WHERE rank <= 20",
    "dominant": """SELECT person_id, legislative_item,
        CASE WHEN wf = 0 AND wa = 0 THEN CASE WHEN b_c IS NOT NULL THEN 'ehdollinen' ELSE 'ei_kantaa' END
          WHEN wf > 0 AND wa > 0 AND least(wf, wa) / greatest(wf, wa) > 0.5 THEN 'ehdollinen' WHEN wf >= wa THEN 'puolesta' ELSE 'vastaan' END AS dominant,
        CASE WHEN wf = 0 AND wa = 0 THEN coalesce(b_c, b_n) WHEN wf > 0 AND wa > 0 AND least(wf, wa) / greatest(wf, wa) > 0.5 THEN b_f
          WHEN wf >= wa THEN b_f ELSE b_a END AS stance_id FROM (
        SELECT person_id, legislative_item, sum(CASE WHEN stance = 'puolesta' THEN confidence + 0.01::double ELSE 0 END) AS wf,
          sum(CASE WHEN stance = 'vastaan' THEN confidence + 0.01::double ELSE 0 END) AS wa,
          max(CASE WHEN rn = 1 AND stance = 'puolesta' THEN id END) AS b_f, max(CASE WHEN rn = 1 AND stance = 'vastaan' THEN id END) AS b_a,
          max(CASE WHEN rn = 1 AND stance = 'ehdollinen' THEN id END) AS b_c, max(CASE WHEN rn = 1 AND stance = 'ei_kantaa' THEN id END) AS b_n
        FROM (SELECT *, row_number() OVER (PARTITION BY person_id, legislative_item, stance ORDER BY confidence DESC, id) AS rn FROM stance) GROUP BY 1, 2)""",
    "words_votes": f"""SELECT person_id, vote_id, speech_id, legislative_item, dominant AS speech_stance, evidence_quote AS speech_quote, speech_date, vote_value, vote_date, vote_stage,
        CASE WHEN alignment = 'ristiriita' AND confidence < 0.7 THEN 'konteksti' ELSE alignment END AS alignment,
        CASE WHEN alignment = 'ristiriita' AND confidence < 0.7 THEN '{C.NOTE_UNSURE}' ELSE note END AS context_note, confidence, model FROM (
        SELECT d.person_id, v.vote_id, s.speech_id, d.legislative_item, dominant, s.evidence_quote, sp.started_at AS speech_date, r.vote_value, v.session_date AS vote_date,
          v.treatment_stage AS vote_stage, s.confidence, s.model,
          CASE WHEN r.vote_value IS NULL OR r.vote_value IN ('Tyhjää', 'Poissa') THEN 'ei_riitä' WHEN v.is_procedural = 1 THEN 'konteksti'
            WHEN v.title <> '{CLEAN_TITLE}' THEN 'konteksti' WHEN dominant IN ('ehdollinen', 'ei_kantaa') THEN 'konteksti'
            WHEN (dominant = 'puolesta') = (r.vote_value = 'Jaa') THEN 'linjassa' ELSE 'ristiriita' END AS alignment,
          CASE WHEN r.vote_value IS NULL OR r.vote_value IN ('Tyhjää', 'Poissa') THEN 'ääni oli ' || coalesce(r.vote_value, 'tuntematon')
            WHEN v.is_procedural = 1 THEN '{C.NOTE_PROCEDURAL}' WHEN v.title <> '{CLEAN_TITLE}' THEN '{C.NOTE_UNCLEAR_VOTE}'
            WHEN dominant IN ('ehdollinen', 'ei_kantaa') THEN '{C.NOTE_OPEN_STANCE}'
            WHEN (dominant = 'puolesta') = (r.vote_value = 'Jaa') THEN '{C.NOTE_ALIGNED}' ELSE '{C.NOTE_CONFLICT}' END AS note
        FROM dominant d JOIN stance s ON s.id = d.stance_id JOIN speech sp ON sp.id = s.speech_id JOIN vote v ON v.legislative_item = d.legislative_item
        LEFT JOIN vote_record r ON r.vote_id = v.vote_id AND r.person_id = d.person_id)""",
    "promise_result": """SELECT promise_id, p.party_code, count(*) FILTER (line = expected_value) AS n_met, count(*) AS n_votes,
        CASE WHEN 2 * count(*) FILTER (line = expected_value) >= count(*) THEN 1 ELSE 0 END AS kept
        FROM promise_vote_map m JOIN promise p ON p.id = m.promise_id AND scope = 'party' AND party_code IS NOT NULL
        JOIN party_line l ON l.vote_id = m.vote_id AND l.party = p.party_code WHERE line IN ('Jaa', 'Ei') GROUP BY 1, 2""",
    "breaker": """SELECT person_id, full_name, party_current, against, eval, round_even(100 * against / eval, 0) AS rate FROM (
        SELECT person_id, count(*) FILTER (2 * a > n) AS against, count(*) AS eval FROM (
          SELECT r.person_id, m.promise_id, count(*) FILTER (vote_value <> expected_value) AS a, count(*) AS n
          FROM promise_vote_map m JOIN promise p ON p.id = m.promise_id AND scope = 'party' AND party_code IS NOT NULL
          JOIN vote_record r ON r.vote_id = m.vote_id AND r.party = p.party_code WHERE vote_value IN ('Jaa', 'Ei') GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 3)
        JOIN person USING (person_id)""",
    "search_tokens": f"SELECT id, {_SEARCH_TOK} AS toks FROM speech",
    "postings": """SELECT term, id AS doc_id, count(*) AS tf, cast(any_value(dl) as int) AS doc_length FROM (
        SELECT id, len(toks) AS dl, unnest(toks) AS term FROM search_tokens) GROUP BY 1, 2""",
    "ingest_state": """SELECT 'votes:' || year(o_orderdate) AS job, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'done' ELSE 'running' END AS status, arg_max(o_custkey, o_orderkey) AS n
        FROM orders GROUP BY 1""",
    "explainer": """SELECT legislative_item, 'changes ' || legislative_item AS what_changes, 'all' AS who_affected, external_key AS ref, right(text, 20) AS quote
        FROM speech QUALIFY row_number() OVER (PARTITION BY legislative_item ORDER BY id DESC) = 1""",
    "bill_speech": """SELECT *, substr(text, length(text) // 3 + 1, 20) AS q_for, substr(text, greatest(length(text) - 30, 1), 20) AS q_against,
          row_number() OVER (PARTITION BY legislative_item ORDER BY id) AS nth, row_number() OVER (PARTITION BY legislative_item ORDER BY id DESC) AS nth_last,
          lead(text) OVER (PARTITION BY legislative_item ORDER BY id) AS next_text FROM speech""",
}


def with_ctes(sql: str) -> str:
    """The query with the model views it mentions, directly or through other views, put in front."""
    need: list[str] = []

    def visit(text: str):
        for name in CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                visit_name(name)

    def visit_name(name: str):
        if name in need:
            return
        visit(CTES[name])
        if name not in need:
            need.append(name)

    visit(sql)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in need)
    if not ctes:
        return sql
    return f"WITH RECURSIVE {ctes}, {sql[15:].lstrip()}" if sql.startswith("WITH RECURSIVE") else \
        f"WITH {ctes}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {ctes}\n{sql}"
