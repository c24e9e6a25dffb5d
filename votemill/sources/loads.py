"""Loads of speeches, bills, promises, surveys, verified claims, caches and photo titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from votemill import constants as C
from votemill.functions import scalars as S
from votemill.operators import corpus
from votemill.operators.relational import first_per_key
from votemill.runtime import materialize


# --- speeches -------------------------------------------------------------------
def store_speeches(parsed: DataFrame, person: DataFrame, existing_keys: DataFrame | None = None) -> DataFrame:
    """New speeches with names and current group of the speaker; known external keys are skipped."""
    new = parsed if existing_keys is None else parsed.join(existing_keys.select("external_key"), "external_key", "left_anti")
    new = first_per_key(new, ["external_key"], ["ptk_id", "started_at"])
    who = person.select("person_id", "first_name", "last_name", F.col("party_current").alias("party"))
    return new.join(who, "person_id", "left").withColumn("url", S.document_url(F.col("ptk_id"), "Poytakirja"))


def sessions_until_gap(sessions: DataFrame, miss_stop: int = 20) -> DataFrame:
    """Sessions ``(year, number)`` that a run from 1 reaches before ``miss_stop`` numbers in a row are missing.

    A year's window holds its distinct session numbers, which a calendar bounds.
    """
    s = sessions.select("year", "number").where(F.col("number") >= 1).distinct()
    w = W.partitionBy("year").orderBy("number")
    missing = F.col("number") - F.coalesce(F.lag("number").over(w), F.lit(0)) - 1
    return (s.withColumn("_stop", (missing >= miss_stop).cast("int"))
            .withColumn("_stopped", F.sum("_stop").over(w)).where(F.col("_stopped") == 0).select("year", "number"))


# --- bills ------------------------------------------------------------------------
def missing_items(vote: DataFrame, legislation: DataFrame | None, item_types=("HE",)) -> DataFrame:
    """Voted bills of the wanted types that have no text yet."""
    kind = F.lit(False)
    for t in item_types:
        kind = kind | F.startswith("legislative_item", F.lit(t + " "))
    items = vote.where(F.col("legislative_item").isNotNull() & kind).select("legislative_item").distinct()
    if legislation is None:
        return items
    return items.join(legislation.select(F.col("eduskunta_tunnus").alias("legislative_item")), "legislative_item", "left_anti")


def legislation_table(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Bill rows for the wanted items; bills without a readable document keep an empty text."""
    t = texts.select(F.col("eduskunta_tunnus").alias("legislative_item"), "title", "summary")
    return (items.join(t, "legislative_item", "left")
            .select(F.col("legislative_item").alias("eduskunta_tunnus"), S.doc_type(F.col("legislative_item")).alias("doc_type"),
                    "title", F.coalesce("summary", F.lit("")).alias("summary"),
                    S.document_url(F.col("legislative_item"), "HallituksenEsitys").alias("url")))


# --- promises -----------------------------------------------------------------------
PROMISE_FILE = ("promises array<struct<id:bigint,scope:string,party_code:string,person_id:bigint,topic_slug:string,"
                "text:string,source_title:string,source_url:string,source_year:int,curated_by:string,note:string>>, "
                "promise_vote_map array<struct<promise_id:bigint,vote_id:bigint,legislative_item:string,"
                "expected_value:string,rationale:string,source_note:string,curated_by:string,mapping_version:string>>")


def read_promises(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Promises and unresolved mappings from promise files: one document per file, or per line."""
    doc = spark.read.schema(PROMISE_FILE).option("multiLine", multi_line).json(path)
    promises = doc.select(F.inline("promises")).withColumn("scope", F.coalesce("scope", F.lit("party")))
    return promises, doc.select(F.inline("promise_vote_map"))


PROVENANCE = ("rationale", "source_note", "curated_by", "mapping_version")


def reloaded_mappings(previous: DataFrame, promises: DataFrame, resolved: DataFrame) -> DataFrame:
    """The mapping table after a load: promises that were loaded again lose their old mappings."""
    kept = previous.join(promises.select(F.col("id").alias("promise_id")), "promise_id", "left_anti")
    return kept.select(*resolved.columns).unionByName(resolved)


def resolve_mappings(mapping: DataFrame, vote: DataFrame) -> DataFrame:
    """Mappings to votes: by vote id, else by bill to its accept-or-reject votes, else to all its substantive votes.

    Whether a bill has accept-or-reject votes is settled once per bill, before mappings meet votes.
    """
    keep = ["promise_id", "vote_id", "expected_value", *[c for c in PROVENANCE if c in mapping.columns]]
    direct = mapping.where(F.col("vote_id").isNotNull()).select(*keep)
    title = F.col("title")
    decisive = title.ilike("%hyväksy%") | title.ilike("%hylk%")
    v = (vote.where((F.col("is_procedural") == 0) & F.col("legislative_item").isNotNull())
         .select("legislative_item", "vote_id", F.coalesce(decisive, F.lit(False)).alias("decisive")))
    has = v.groupBy("legislative_item").agg(F.bool_or("decisive").alias("any_decisive"))
    usable = v.join(has, "legislative_item").where(F.col("decisive") | ~F.col("any_decisive"))
    by_item = (mapping.where(F.col("vote_id").isNull() & F.col("legislative_item").isNotNull()).drop("vote_id")
               .join(usable.select("legislative_item", "vote_id"), "legislative_item").select(*keep))
    return direct.unionByName(by_item)


# --- survey ---------------------------------------------------------------------------
def sniff_delimiter(header: str) -> str:
    return ";" if header.count(";") > header.count(",") else ","


def read_survey(spark: SparkSession, path: str, background=C.SURVEY_BACKGROUND_COLUMNS,
                party: str = "puolue", min_title: int = 15) -> tuple[DataFrame, str, dict[str, int]]:
    """Wide survey file: the frame, its party column, and statement columns numbered from 1.

    Only the first line is looked at on the driver, to find separator and columns.
    """
    header = spark.read.text(path).first()[0].lstrip("﻿")
    wide = (spark.read.option("header", True).option("sep", sniff_delimiter(header)).option("encoding", "UTF-8")
            .option("quote", '"').option("escape", '"').csv(path))
    wide = wide.toDF(*[c.lstrip("﻿").strip() for c in wide.columns])
    party_col = next(c for c in wide.columns if c.lower() == party)
    statements = [c for c in wide.columns if c.lower() not in background and len(c) > min_title]
    return wide, party_col, {c: i for i, c in enumerate(statements, 1)}


# --- claims that must quote their source -------------------------------------------------
STANCE_FILE = ("model_label string, stances array<struct<speech_id:bigint,legislative_item:string,proposition:string,"
               "stance:string,conditional_note:string,evidence_quote:string,confidence:double>>")


def read_claims(spark: SparkSession, path: str, schema: str, column: str, multi_line: bool = True) -> DataFrame:
    """Claims of a file format below, with their place in the document."""
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return doc.select("model_label", F.posexplode(column)).select("model_label", "pos", "col.*")


def verified_stances(claims: DataFrame, speech: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Stance rows whose quote stands word for word in the speech; the last per (speech, proposition) stays."""
    ok = (claims.join(speech.select(F.col("id").alias("speech_id"), "person_id", "text"), "speech_id")
          .where((F.col("text") != "") & F.contains("text", F.col("evidence_quote"))).drop("text"))
    rest = ["person_id", "legislative_item", "stance", "conditional_note", "evidence_quote", "confidence", "model_label"]
    # a claim without proposition equals no other
    own = F.when(F.col("proposition").isNull(), F.col("pos")).alias("_own")
    last = (ok.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
            .groupBy("speech_id", "proposition", own).agg(F.max(F.struct("pos", *rest)).alias("r"))
            .select("speech_id", "proposition", *[F.col("r")[c].alias(c) for c in rest])
            .withColumnRenamed("model_label", "model"))
    if previous is None:
        return last
    return previous.join(last.select("speech_id", "proposition"), ["speech_id", "proposition"], "left_anti") \
        .select(*last.columns).unionByName(last)


def unquoted(claims: DataFrame, key: str, item: str, quotes: Column, speech: DataFrame,
             legislation: DataFrame | None = None) -> DataFrame:
    """Claims ``(key)`` with a quote that does not stand in the corpus of their bill: its speeches by id, then its summary, a blank between them.

    The quotes of a bill, a few short strings, travel as one array to its texts,
    and each text is scanned once; what no text holds is looked for across the
    seams of texts, in windows around them (see ``corpus.across_seams``).
    """
    q = (claims.select(F.col(key), F.col(item).alias("_item"), F.explode(quotes).alias("_quote"))
         .where(F.coalesce("_quote", F.lit("")) != ""))
    texts = speech.where(F.col("text").isNotNull()).select(F.col("legislative_item").alias("_item"), F.lit(0).alias("_last"), F.col("id").alias("_id"), "text")
    if legislation is not None:
        texts = texts.unionByName(legislation.where(F.col("summary") != "").select(
            F.col("eduskunta_tunnus").alias("_item"), F.lit(1).alias("_last"), F.lit(0).cast("long").alias("_id"), F.col("summary").alias("text")))
    asked = q.groupBy("_item").agg(F.collect_set("_quote").alias("_quotes"))
    held = F.filter("_quotes", lambda quote: F.contains(F.col("text"), quote))
    found = texts.join(asked, "_item").select("_item", F.explode(held).alias("_quote")).distinct()
    left = materialize(q.join(found, ["_item", "_quote"], "left_anti"), "quotes-left")
    seams = corpus.across_seams(left.select("_item", "_quote").distinct(), texts, "_item", ["_last", "_id"], "text", "_quote")
    return left.join(seams, ["_item", "_quote"], "left_anti").select(key).distinct()


EXPLAINER_FILE = ("model_label string, explainers array<struct<legislative_item:string,what_changes:string,"
                  "who_affected:string,contested:string,sources:array<struct<type:string,ref:string,quote:string>>>>")


def verified_explainers(claims: DataFrame, speech: DataFrame, legislation: DataFrame) -> DataFrame:
    """Explainers whose every quote stands in the bill's speeches or summary; the last per bill stays."""
    rows = claims.withColumn("_k", F.struct("legislative_item", "pos"))
    bad = unquoted(rows, "_k", "legislative_item", F.transform("sources", lambda s: s["quote"]), speech, legislation)
    ok = rows.join(bad, "_k", "left_anti")
    return ok.groupBy("legislative_item").agg(F.max_by(F.struct(
        "what_changes", "who_affected", "contested", F.to_json("sources").alias("sources_json"),
        F.col("model_label").alias("model")), F.col("pos")).alias("r")).select("legislative_item", "r.*")


_ARG = "array<struct<argument:string,speaker:string,party:string,quote:string>>"
PROSCONS_FILE = f"model_label string, proscons array<struct<vote_id:bigint,note:string,pro:{_ARG},con:{_ARG}>>"


def verified_proscons(claims: DataFrame, vote: DataFrame, speech: DataFrame) -> DataFrame:
    """Pro and con arguments of known votes, every quote found in a speech on the bill."""
    rows = (claims.join(vote.select("vote_id", "legislative_item"), "vote_id")
            .withColumn("_k", F.struct("vote_id", "pos")))
    quotes = F.transform(F.concat(F.coalesce("pro", F.array().cast(_ARG)), F.coalesce("con", F.array().cast(_ARG))),
                         lambda a: a["quote"])
    ok = rows.join(unquoted(rows, "_k", "legislative_item", quotes, speech), "_k", "left_anti")
    return ok.groupBy("vote_id").agg(F.max_by(F.struct(
        F.to_json("pro").alias("pro_json"), F.to_json("con").alias("con_json"), "note",
        F.col("model_label").alias("model")), F.col("pos")).alias("r")).select("vote_id", "r.*")


# --- extraction cache -----------------------------------------------------------------------
def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a NUL."""
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(*[x for p in parts for x in (p, nul)]), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, max_calls: int) -> DataFrame:
    """Requests ``(request_id, model, system, user, schema_json)`` with status hit, pending or over_budget.

    Equal requests share one call; the first ``max_calls`` distinct misses in request order are pending.
    """
    keyed = requests.withColumn("key", cache_key(*[F.col(c) for c in ("model", "system", "user", "schema_json")]))
    joined = keyed.join(cache.select("key", "response_json"), "key", "left")
    misses = joined.where(F.col("response_json").isNull()).groupBy("key").agg(F.min("request_id").alias("_first"))
    granted = misses.orderBy("_first").limit(max_calls).select("key", F.lit(1).alias("_granted"))
    status = F.when(F.col("response_json").isNotNull(), "hit").when(F.col("_granted") == 1, "pending").otherwise("over_budget")
    return joined.join(granted, "key", "left").withColumn("status", status).drop("_granted")


# --- photo titles ------------------------------------------------------------------------------
def resolve_titles(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Follows ``(from, to)`` edges from each name to its final title; a cycle ends where it closes.

    ``edges`` has one row per ``from``.  Pointers are doubled, so a chain of n
    hops takes log n joins.  Titles without an edge point at themselves; once
    doubling no longer shrinks the set of titles pointed at, that set is the
    titles on cycles (and the ends), and every name goes to the first of them
    on its way.
    """
    step = edges.select(F.col("from").alias("name"), F.col("to").alias("next"))
    every = names.select("name").union(step.select("name")).union(step.select("next")).distinct()
    one = materialize(every.join(step, "name", "left").select("name", F.coalesce("next", "name").alias("next")), "title-hop")
    jump, held = one, None
    while True:
        reached = materialize(jump.select(F.col("next").alias("name")).distinct(), "titles-reached")
        size = reached.count()
        if size == held:
            break
        held, jump = size, _twice(jump)
    stay = one.join(reached.withColumn("settled", F.lit(True)), "name", "left")
    walk = materialize(stay.select("name", F.when(F.col("settled"), F.col("name")).otherwise(F.col("next")).alias("next")), "title-walk")
    while True:
        further = _twice(walk)
        moved = further.join(walk.withColumnRenamed("next", "before"), "name").where(F.col("next") != F.col("before"))
        if moved.isEmpty():
            return walk.join(names.select("name"), "name", "left_semi").select("name", F.col("next").alias("title"))
        walk = further


def _twice(jump: DataFrame) -> DataFrame:
    """Each pointer followed by that of its target."""
    onward = jump.select(F.col("name").alias("next"), F.col("next").alias("_beyond"))
    return materialize(jump.join(onward, "next").select("name", F.col("_beyond").alias("next")), "title-jump")


def photos(person: DataFrame, edges: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Thumbnail and file page of every person whose resolved title has one."""
    final = resolve_titles(person.select(F.col("full_name").alias("name")).where("name is not null").distinct(), edges)
    return (person.join(final, person["full_name"] == final["name"]).join(thumbs, "title")
            .select("person_id", "title", F.col("thumb").alias("photo_url"),
                    S.file_page_url(F.col("thumb")).alias("photo_credit_url")))
