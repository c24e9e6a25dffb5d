"""Published result sets, computed for all members, votes, bills and topics at once.

A page about one id is a filter on the matching table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from votemill import constants as C
from votemill.functions import scalars as S
from votemill.operators import relational as R


def _n() -> Column:
    return F.count(F.lit(1))


def _absent_pct() -> Column:
    return F.when(F.col("n_votes_total") > 0, 100.0 * F.col("n_absent") / F.col("n_votes_total"))


# --- members ------------------------------------------------------------------
def member_attributes(summary: DataFrame, person: DataFrame, member_topic: DataFrame,
                      year: int = C.RATING_YEAR) -> DataFrame:
    """Five 1..99 ratings per member: speaking, presence, topic breadth, experience, independence."""
    breadth = member_topic.where("n_speeches > 0").groupBy("person_id").agg(_n().alias("breadth"))
    raw = (summary.join(breadth, "person_id", "left").join(person.select("person_id", "active_from"), "person_id", "left")
           .select("person_id", F.coalesce("n_speeches", F.lit(0)).alias("speaking"),
                   F.when(F.col("n_votes_total") > 0, 100.0 * F.col("n_votes_cast") / F.col("n_votes_total")).alias("presence"),
                   F.coalesce("breadth", F.lit(0)).alias("topics"),
                   (year - F.substring("active_from", 1, 4).cast("int")).alias("experience"),
                   F.col("deviation_rate").alias("independence")))
    return R.percentile_ratings(raw, "person_id", ["speaking", "presence", "topics", "experience", "independence"])


def top_topic(member_topic: DataFrame, topic: DataFrame, fallback: str = C.FALLBACK_TOPIC) -> DataFrame:
    """The topic a member speaks about most (lowest id on a tie)."""
    named = topic.where(F.col("slug") != fallback).select(F.col("id").alias("topic_id"), F.col("label"))
    return (member_topic.where("n_speeches > 0").join(named, "topic_id").groupBy("person_id")
            .agg(F.min_by("label", F.struct(-F.col("n_speeches"), F.col("topic_id"))).alias("top_topic")))


AWARD_MIN = {"absent": 500, "rebel": 200, "loyal": 1000, "words": 5000}


def awards(summary: DataFrame, person: DataFrame, usage: DataFrame, breaker: DataFrame,
           minimum: dict[str, int] = AWARD_MIN) -> DataFrame:
    """One leader per category: ``(key, person_id, full_name, party_current, v, value_text)``."""
    who = person.select("person_id", "full_name", "party_current", "is_minister")
    s, u = summary.join(who, "person_id"), usage.join(who, "person_id")

    def leader(df, key, value, text, descending=True, where=None):
        df = df if where is None else df.where(where)
        df = df.select(F.lit(key).alias("key"), "person_id", "full_name", "party_current",
                       value.cast("double").alias("v"), text.alias("value_text")).where(F.col("v").isNotNull())
        order = F.desc(F.round("v", 9)) if descending else F.asc(F.round("v", 9))
        return df.orderBy(order, "person_id").limit(1)

    dev = 100.0 * F.col("deviation_rate")
    dev_text = F.format_string("%.1f %% poikkeama", dev)
    rows = [
        leader(s, "speeches", F.col("n_speeches"), F.format_string("%d puhetta", F.col("n_speeches"))),
        leader(s, "absent", _absent_pct(), F.format_string("%.0f %% poissa", _absent_pct()),
               where=(F.col("n_votes_total") >= minimum["absent"]) & (F.col("is_minister") == 0)),
        leader(s, "rebel", dev, dev_text, where=F.col("n_votes_eligible") >= minimum["rebel"]),
        leader(s, "loyal", dev, dev_text, descending=False, where=F.col("n_votes_eligible") >= minimum["loyal"]),
        *[leader(u, cat, F.col("per_1000"), F.format_string("%.2f / 1000 sanaa", F.col("per_1000")),
                 where=(F.col("category") == cat) & (F.col("n_words") >= minimum["words"])) for cat in ("filler", "swear")],
        breaker.orderBy(F.desc("rate"), F.desc("eval"), "person_id").limit(1).select(
            F.lit("flip").alias("key"), "person_id", "full_name", "party_current", F.col("rate").cast("double").alias("v"),
            F.format_string("%d/%d lupausta vastaan", F.col("against"), F.col("eval")).alias("value_text")),
    ]
    return reduce(DataFrame.unionByName, rows)


def award_holders(award: DataFrame) -> DataFrame:
    """Categories held per member (at most one row per category goes in)."""
    return (award.groupBy("person_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
            .select("person_id", F.size("keys").alias("n_awards"), F.array_join("keys", ",").alias("awards")))


def seeded_sample(df: DataFrame, id_col: str, k: int, seed: str = "0") -> DataFrame:
    """Reproducible random ``k`` rows: smallest hashes of id and seed."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":" + seed))), id_col).limit(k)


def index_highlights(summary: DataFrame, person: DataFrame, vote: DataFrame, speech: DataFrame,
                     speech_topic: DataFrame, topic: DataFrame, member_topic: DataFrame, *, min_eligible: int = 200, min_side: int = 40,
                     fallback: str = C.FALLBACK_TOPIC, seed: str = "0") -> DataFrame:
    """A random eligible member, the tightest vote of the latest year, the topic of the latest year.

    ``detail`` and ``value`` are the member's top topic and index, and the vote's bill and year.
    """
    spot = (seeded_sample(summary.where(F.col("n_votes_eligible") >= min_eligible).join(person, "person_id"),
                          "person_id", 1, seed)
            .join(top_topic(member_topic, topic, fallback), "person_id", "left")
            .select(F.lit("spotlight").alias("section"), F.col("person_id").cast("string").alias("id"),
                    F.col("full_name").alias("label"), F.col("n_votes_cast").cast("long").alias("n"),
                    F.col("top_topic").alias("detail"), F.col("consistency_index").cast("long").alias("value")))
    tight = (vote.where((F.col("is_procedural") == 0) & (F.col("result_yes") > min_side) & (F.col("result_no") > min_side))
             .withColumn("margin", F.abs(F.col("result_yes") - F.col("result_no")))
             .orderBy(F.desc("vp_year"), "margin", "vote_id").limit(1)
             .select(F.lit("tight").alias("section"), F.col("vote_id").cast("string").alias("id"),
                     F.col("title").alias("label"), F.col("margin").cast("long").alias("n"),
                     F.col("legislative_item").alias("detail"), F.col("vp_year").cast("long").alias("value")))
    latest = speech.agg(F.max(F.substring("started_at", 1, 4))).scalar()
    trend = (speech.where(F.substring("started_at", 1, 4) == latest).select(F.col("id").alias("speech_id"))
             .join(speech_topic.where("is_primary = 1"), "speech_id")
             .groupBy("topic_id").agg(_n().alias("n"))
             .join(topic.where(F.col("slug") != fallback), F.col("topic_id") == F.col("id"))
             .orderBy(F.desc("n"), "topic_id").limit(1)
             .select(F.lit("trend").alias("section"), F.col("slug").alias("id"), "label", F.col("n").cast("long").alias("n"),
                     F.lit(None).cast("string").alias("detail"), F.lit(None).cast("long").alias("value")))
    return spot.unionByName(tight).unionByName(trend)


def person_profile(person: DataFrame, party: DataFrame, term: DataFrame, role: DataFrame, summary: DataFrame) -> DataFrame:
    """A row per person with nested histories and the summary columns.

    The histories are child records of one biography, not an open-ended log.
    """
    def nested(df, cols, out):
        key = F.coalesce("start_date", F.lit("")).alias("start_key")
        return df.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct(key, *cols))).alias(out))

    return (person.join(nested(party, ["group_code", "group_name", "start_date", "end_date"], "parties"), "person_id", "left")
            .join(nested(term, ["start_date", "end_date"], "terms"), "person_id", "left")
            .join(nested(role, ["title", "government", "start_date", "end_date"], "minister_roles"), "person_id", "left")
            .join(summary, "person_id", "left"))


def person_topics(member_topic: DataFrame, topic: DataFrame) -> DataFrame:
    return (member_topic.where("n_speeches > 0 or n_votes > 0")
            .join(topic.select(F.col("id").alias("topic_id"), "slug", "label"), "topic_id")
            .select("person_id", "slug", "label", "n_speeches", "n_votes", (F.col("n_speeches") + F.col("n_votes")).alias("total")))


def person_behavior(vote_record: DataFrame) -> DataFrame:
    return vote_record.where(F.col("person_id").isNotNull()).groupBy("person_id", "vote_value").agg(_n().alias("n"))


def person_deviations(deviation: DataFrame, vote: DataFrame, limit: int = 25) -> DataFrame:
    """Latest deviating votes of every member."""
    v = vote.select("vote_id", "session_date", "title", "legislative_item")
    d = deviation.where(F.col("classification") == C.DEVIATES).join(v, "vote_id")
    return R.top_n(d, ["person_id"], [F.desc("session_date"), F.asc("vote_id")], limit) \
        .select("person_id", "rank", "vote_id", "party", "member_value", "party_line", "session_date", "title", "legislative_item")


def person_speeches(speech: DataFrame, limit: int = 20, chars: int = 200) -> DataFrame:
    """Latest speeches of every member with a preview; the full text stays out of the exchange."""
    s = speech.where(F.col("person_id").isNotNull()).select(
        "person_id", "id", "ptk_id", "speech_type", "started_at", "legislative_item", "word_count",
        S.preview(F.col("text"), chars).alias("preview"))
    return R.top_n(s, ["person_id"], [F.desc("started_at"), F.asc("id")], limit)


def person_changes(change: DataFrame, topic: DataFrame) -> DataFrame:
    t = topic.select(F.col("id").alias("topic_id"), F.col("label").alias("topic"))
    return change.join(t, "topic_id", "left").select(
        "person_id", "item_base", "stage", "from_value", "from_date", "to_value", "to_date", "gap_days", "topic")


def person_recent_votes(vote_record: DataFrame, vote: DataFrame, deviation: DataFrame, limit: int = 20) -> DataFrame:
    """Latest votes of every member, with line and class where there is one."""
    v = vote.select("vote_id", "session_date", "title", "legislative_item")
    rec = vote_record.where(F.col("person_id").isNotNull()).select("person_id", "vote_id", "vote_value").join(v, "vote_id")
    top = R.top_n(rec, ["person_id"], [F.desc("session_date"), F.asc("vote_id")], limit)
    d = deviation.select("vote_id", "person_id", "party_line", "classification")
    return top.join(d, ["vote_id", "person_id"], "left")


def person_word_style(usage: DataFrame, hits: DataFrame, limit: int = 6) -> DataFrame:
    """Rates with the most used words per member and category."""
    top = (R.top_n(hits, ["person_id", "category"], [F.desc("n"), F.asc("word")], limit)
           .groupBy("person_id", "category").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top")))
    return usage.join(top, ["person_id", "category"], "left")


def person_words_votes(ledger: DataFrame, vote: DataFrame) -> DataFrame:
    """The ledger with vote titles: one row per (member, bill, vote), ready to group by bill."""
    v = vote.select("vote_id", F.col("title").alias("vote_title"), "session_date")
    return ledger.join(v, "vote_id").select(
        "person_id", "legislative_item", F.col("speech_stance").alias("stance"), F.col("speech_quote").alias("quote"),
        "speech_id", "speech_date", "vote_id", "vote_value", "alignment", "context_note", "vote_title", "session_date")


def person_highlights(summary: DataFrame, ledger: DataFrame, change: DataFrame) -> DataFrame:
    """Short fact sentences per member: ``(person_id, pos, text, anchor)``."""
    wv = ledger.groupBy("person_id").agg(
        F.count_if(F.col("alignment") == C.CONFLICT).alias("ris"), F.count_if(F.col("alignment") == C.RELUCTANT).alias("vas"))
    pc = change.groupBy("person_id").agg(_n().alias("changes"))
    base = summary.join(wv, "person_id", "full").join(pc, "person_id", "full").na.fill(0, ["ris", "vas", "changes", "n_deviations"])

    def fact(pos, cond, text, anchor):
        return F.when(cond, F.struct(F.lit(pos).alias("pos"), text.alias("text"), F.lit(anchor).alias("anchor")))

    conflict = F.concat_ws(" · ",
                           F.when(F.col("ris") > 0, F.format_string("%d puheen ja äänen ristiriita", F.col("ris"))),
                           F.when(F.col("vas") > 0, F.format_string("%d vastentahtoinen ääni", F.col("vas"))))
    facts = F.array_compact(F.array(
        fact(1, F.col("n_deviations") > 0, F.format_string(
            "Äänesti %d kertaa eri tavalla kuin oma ryhmänsä enemmistö", F.col("n_deviations")), "#aanet"),
        fact(2, F.col("consistency_index").isNotNull(), F.format_string(
            "Johdonmukaisuusindeksi %d/100 (%s luottamus)", F.col("consistency_index"),
            F.coalesce("confidence_level", F.lit("—"))), "#indeksi"),
        fact(3, (F.col("ris") > 0) | (F.col("vas") > 0), F.concat(conflict, F.lit(" kirjattu")), "#sanat-aanet"),
        fact(4, F.col("changes") > 0, F.format_string(
            "%d kannanmuutosta samasta säädöskohteesta", F.col("changes")), "#muutokset")))
    return base.select("person_id", F.inline_outer(facts)).where(F.col("text").isNotNull())


SORT_KEYS = {
    "nimi": "full_name", "puolue": "party_current", "puheet": "n_speeches", "aanet": "n_votes_cast",
    "poissa": "n_absent", "poissa_pct": "absent_pct", "poikkeama": "deviation_rate", "indeksi": "consistency_index",
}


def member_directory(person: DataFrame, summary: DataFrame, *, sort: str = "nimi", descending: bool = False,
                     party: str | None = None, min_eligible: int = 0) -> DataFrame:
    """Filterable directory, nulls last in both directions, ties by name."""
    rows = person.join(summary, "person_id").withColumn("absent_pct", _absent_pct())
    if party:
        rows = rows.where(F.col("party_current") == party)
    if min_eligible:
        rows = rows.where(F.col("n_votes_eligible") >= min_eligible)
    col = F.col(SORT_KEYS.get(sort, "full_name"))
    return (rows.orderBy(col.desc_nulls_last() if descending else col.asc_nulls_last(), "full_name", "person_id")
            .select("person_id", "full_name", "party_current", "electoral_district", "active_from", "is_minister",
                    "n_speeches", "n_votes_cast", "n_votes_total", "n_absent", "n_votes_eligible", "deviation_rate",
                    "consistency_index", "confidence_level", "absent_pct"))


def member_cards(directory: DataFrame, member_topic: DataFrame, topic: DataFrame, holders: DataFrame | None = None, *,
                 radar=C.RADAR_TOPICS, limit: int | None = None, order: list[Column] | None = None,
                 fallback: str = C.FALLBACK_TOPIC) -> DataFrame:
    """Directory slice with a radar scaled by its own maximum, the top topic, rarity and traits."""
    order = order or [F.col("n_speeches").desc_nulls_last(), F.col("full_name"), F.col("person_id")]
    head = directory.orderBy(*order).limit(limit) if limit else directory
    slugs = topic.select(F.col("id").alias("topic_id"), "slug")
    vec = (member_topic.join(slugs, "topic_id").where(F.col("slug").isin(*radar))
           .groupBy("person_id").pivot("slug", list(radar)).agg(F.first("n_speeches")))
    axes = F.array(*[F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in radar])
    scale = F.greatest(F.array_max(axes), F.lit(1))
    first_year = F.substring("active_from", 1, 4).try_cast("int")
    out = (head.join(vec, "person_id", "left").join(top_topic(member_topic, topic, fallback), "person_id", "left")
           .withColumn("radar", F.transform(axes, lambda x: x / scale)).drop(*radar))
    out = out.join(holders.select("person_id", "n_awards"), "person_id", "left") if holders is not None \
        else out.withColumn("n_awards", F.lit(0))
    return (out.withColumn("rarity", S.card_rarity(F.coalesce("n_awards", F.lit(0)), F.col("is_minister"), F.col("n_speeches"), first_year))
            .withColumn("traits", S.card_traits(F.col("is_minister"), first_year, F.col("absent_pct"))))


def compare(pairs: DataFrame, person: DataFrame, summary: DataFrame, behavior: DataFrame, topics: DataFrame) -> DataFrame:
    """Requested pairs ``(a, b)`` with both members side by side, their topics nested, most active first."""
    # a member has at most as many topics as the lexicon
    busy = topics.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("total")).alias("order"), "slug", "n_speeches", "n_votes"))).alias("topics"))
    dist = behavior.groupBy("person_id").pivot("vote_value", [C.YES, C.NO, C.BLANK, C.ABSENT]).agg(F.first("n"))
    one = (person.select("person_id", "full_name", "party_current")
           .join(summary.select("person_id", "n_speeches", "consistency_index", "deviation_rate"), "person_id", "left")
           .join(dist, "person_id", "left").join(busy, "person_id", "left"))

    def side(tag):
        return one.select(*[F.col(f"`{c}`").alias(f"{tag}_{c}" if c != "person_id" else tag) for c in one.columns])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")


def activity_scatter(summary: DataFrame, person: DataFrame, limit: int | None = None) -> DataFrame:
    out = (summary.where("n_votes_cast > 0").join(person.select("person_id", "full_name", "party_current"), "person_id")
            .select("person_id", "full_name", "party_current", "n_speeches", "n_votes_cast", _absent_pct().alias("absent_pct"))
            .orderBy(F.desc("n_votes_cast"), "person_id"))
    return out.limit(limit) if limit else out


def word_leaderboard(usage: DataFrame, person: DataFrame, category: str, *, descending: bool = True,
                     limit: int = 15, min_words: int = 5000) -> DataFrame:
    order = F.desc("per_1000") if descending else F.asc("per_1000")
    return (usage.where((F.col("category") == category) & (F.col("n_words") >= min_words))
            .join(person.select("person_id", "full_name", "party_current"), "person_id")
            .orderBy(order, F.desc("n_words"), "person_id").limit(limit)
            .select("person_id", "full_name", "party_current", "per_1000", "n_hits", "n_words"))


def word_zero_count(usage: DataFrame, min_words: int = 5000) -> DataFrame:
    return (usage.groupBy("category")
            .agg(F.count_if((F.col("n_words") >= min_words) & (F.col("n_hits") == 0)).alias("n_zero")))


# --- groups -------------------------------------------------------------------
def party_members(person: DataFrame, summary: DataFrame) -> DataFrame:
    s = summary.select("person_id", "consistency_index", "deviation_rate", "confidence_level")
    return (person.where(F.col("party_current").isNotNull())
            .select("party_current", "person_id", "full_name", "electoral_district").join(s, "person_id", "left"))


def party_word_list(words: DataFrame, limit: int = 25) -> DataFrame:
    return words.where(F.col("rank") <= limit).select("party", "rank", "word", "zscore", "n_party", "n_total")


def party_top_words(words: DataFrame, per_party: int = 6) -> DataFrame:
    return (words.where(F.col("rank") <= per_party).groupBy("party")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("w"))
            .select("party", F.transform("w", lambda x: x["word"]).alias("words")))


def party_overview(person: DataFrame, summary: DataFrame) -> DataFrame:
    return (person.where(F.col("party_current").isNotNull()).join(summary, "person_id", "left")
            .groupBy("party_current")
            .agg(F.coalesce(F.max("party_current_name"), F.col("party_current")).alias("name"), _n().alias("n"),
                 F.avg("consistency_index").alias("avg_idx"), F.avg("deviation_rate").alias("avg_dev")))


def parties(person: DataFrame) -> DataFrame:
    return (person.where(F.col("party_current").isNotNull()).groupBy(F.col("party_current").alias("code"))
            .agg(F.coalesce(F.max("party_current_name"), F.col("code")).alias("name"), _n().alias("n")))


def party_comparison(person: DataFrame, summary: DataFrame, min_members: int = 3) -> DataFrame:
    return (person.where(F.col("party_current").isNotNull()).join(summary, "person_id")
            .groupBy(F.col("party_current").alias("code"))
            .agg(F.coalesce(F.max("party_current_name"), F.col("code")).alias("name"), _n().alias("n_members"),
                 F.sum("n_speeches").alias("speeches"), F.round(F.avg("n_speeches"), 0).alias("avg_speeches"),
                 F.round(F.avg("consistency_index"), 1).alias("avg_idx"),
                 F.round(F.avg("deviation_rate") * 100, 2).alias("avg_dev"),
                 F.round(F.avg(_absent_pct()), 1).alias("avg_absent"))
            .where(F.col("n_members") >= min_members))


def power_overview(effect: DataFrame, min_votes: int = 2000) -> DataFrame:
    """Win share in and out of office side by side, groups with enough votes in all."""
    wide = effect.groupBy("party").pivot("status", ["gov", "opp"]).agg(F.first("win_pct").alias("pct"), F.first("n_votes").alias("n"))
    total = F.coalesce("gov_n", F.lit(0)) + F.coalesce("opp_n", F.lit(0))
    return wide.where(total >= min_votes)


def lost_votes(lost: DataFrame, vote: DataFrame) -> DataFrame:
    return lost.join(vote, "vote_id").select("vote_id", "margin", "vp_year", "title", "legislative_item", "result_yes", "result_no")


# --- topics -------------------------------------------------------------------
def topics(topic: DataFrame, speech_topic: DataFrame, vote_topic: DataFrame, fallback: str = C.FALLBACK_TOPIC) -> DataFrame:
    s = speech_topic.groupBy("topic_id").agg(_n().alias("n_speeches"))
    v = vote_topic.groupBy("topic_id").agg(_n().alias("n_votes"))
    return (topic.where(F.col("slug") != fallback).withColumnRenamed("id", "topic_id")
            .join(s, "topic_id", "left").join(v, "topic_id", "left").na.fill(0, ["n_speeches", "n_votes"]))


def topic_top_speeches(speech: DataFrame, speech_topic: DataFrame, limit: int = 30, chars: int = 160) -> DataFrame:
    """Best-scored speeches per topic; texts join only after the cut."""
    top = R.top_n(speech_topic, ["topic_id"], [F.desc("score"), F.asc("speech_id")], limit).select("topic_id", "rank", "speech_id", "score")
    s = speech.select(F.col("id").alias("speech_id"), "first_name", "last_name", "party", "started_at",
                      S.preview(F.col("text"), chars).alias("preview"))
    return top.join(s, "speech_id")


def topic_latest_votes(vote: DataFrame, vote_topic: DataFrame, limit: int = 30) -> DataFrame:
    v = vote_topic.select("topic_id", "vote_id", "score").join(
        vote.select("vote_id", "session_date", "title", "legislative_item"), "vote_id")
    return R.top_n(v, ["topic_id"], [F.desc("session_date"), F.asc("vote_id")], limit)


def topic_top_speakers(speech: DataFrame, speech_topic: DataFrame, limit: int = 10) -> DataFrame:
    n = (speech.where(F.col("person_id").isNotNull())
         .select(F.col("id").alias("speech_id"), "person_id", "first_name", "last_name", "party")
         .join(speech_topic.select("speech_id", "topic_id"), "speech_id").groupBy("topic_id", "person_id")
         .agg(F.min("first_name").alias("first_name"), F.min("last_name").alias("last_name"),
              F.min("party").alias("party"), _n().alias("n")))
    return R.top_n(n, ["topic_id"], [F.desc("n"), F.asc("person_id")], limit)


def topic_trends(speech: DataFrame, speech_topic: DataFrame, topic: DataFrame, years=C.TREND_YEARS,
                 fallback: str = C.FALLBACK_TOPIC) -> DataFrame:
    """Primary-topic speeches per topic and year, zeros filled in."""
    n = (speech.where(F.col("started_at").isNotNull())
         .select(F.col("id").alias("speech_id"), F.substring("started_at", 1, 4).cast("int").alias("year"))
         .join(speech_topic.where("is_primary = 1").select("speech_id", "topic_id"), "speech_id")
         .groupBy("topic_id", "year").agg(_n().alias("n")))
    rows = topic.where(F.col("slug") != fallback).select(F.col("id").alias("topic_id"), "slug")
    return R.zero_grid(rows, "year", list(years), n, ["topic_id", "year"], "n")


def topic_ownership(speech: DataFrame, speech_topic: DataFrame, topic: DataFrame, *, years=C.TREND_YEARS,
                    parties=C.OWNERSHIP_PARTIES, other: str = C.OTHER_PARTIES) -> DataFrame:
    """Yearly share of each group in a topic's primary speeches, small groups folded together."""
    party = F.when(F.col("party").isin(*parties), F.col("party")).otherwise(other)
    n = (speech.where(F.col("party").isNotNull() & F.col("started_at").isNotNull())
         .select(F.col("id").alias("speech_id"), F.substring("started_at", 1, 4).cast("int").alias("year"), party.alias("party"))
         .join(speech_topic.where("is_primary = 1").select("speech_id", "topic_id"), "speech_id")
         .groupBy("topic_id", "year", "party").agg(_n().alias("n")))
    rows = (topic.select(F.col("id").alias("topic_id"), "slug")
            .withColumn("year", F.explode(F.array(*[F.lit(y) for y in years]))))
    grid = R.zero_grid(rows, "party", [*parties, other], n, ["topic_id", "year", "party"], "n")
    total = F.sum("n").over(W.partitionBy("topic_id", "year"))
    return grid.withColumn("share", F.bround(100 * F.col("n") / F.when(total == 0, 1).otherwise(total), 1))


def topic_timeline(vote: DataFrame, vote_topic: DataFrame, explainer: DataFrame, limit: int = 40) -> DataFrame:
    """First substantive votes of every topic in time order, flagged where the bill is explained."""
    v = (vote.where((F.col("is_procedural") == 0) & F.col("session_date").isNotNull())
         .select("vote_id", "session_date", "legislative_item", "title", "result_yes", "result_no")
         .join(vote_topic.select("vote_id", "topic_id"), "vote_id"))
    top = R.top_n(v, ["topic_id"], [F.asc("session_date"), F.asc("vote_id")], limit)
    known = explainer.select("legislative_item").distinct().withColumn("_e", F.lit(1))
    return top.join(known, "legislative_item", "left").withColumn("has_explainer", F.coalesce("_e", F.lit(0))).drop("_e")


# --- votes, speeches, bills -----------------------------------------------------
def vote_detail(vote: DataFrame, vote_record: DataFrame, unknown: str = "(tuntematon)") -> DataFrame:
    """All of a vote as ``(vote_id, section, party, person_id, value, n)``: its header, the members' votes, and the counts per group and value.

    Each group has a row for the four known values, and one for any other value that occurs.
    """
    head = vote.select("vote_id", F.lit("vote").alias("section"), F.lit(None).cast("string").alias("party"), F.lit(None).cast("long").alias("person_id"),
                       F.col("title").alias("value"), F.col("result_total").cast("long").alias("n"))
    party = F.coalesce("party", F.lit(unknown)).alias("party")
    rows = vote_record.select("vote_id", F.lit("record").alias("section"), party, "person_id", F.col("vote_value").alias("value"), F.lit(None).cast("long").alias("n"))
    known = [C.YES, C.NO, C.BLANK, C.ABSENT]
    counted = vote_record.groupBy("vote_id", party, F.col("vote_value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    none = counted.select("vote_id", "party").distinct().select("vote_id", "party", F.explode(F.array(*[F.lit(v) for v in known])).alias("value"), F.lit(0).cast("long").alias("n"))
    sums = (counted.unionByName(none).groupBy("vote_id", "party", "value").agg(F.sum("n").alias("n"))
            .select("vote_id", F.lit("party").alias("section"), "party", F.lit(None).cast("long").alias("person_id"), "value", "n"))
    return head.unionByName(rows).unionByName(sums)


def item_topics(topics_of: DataFrame, topic: DataFrame, key: str) -> DataFrame:
    return topics_of.join(topic.select(F.col("id").alias("topic_id"), "slug", "label"), "topic_id") \
        .select(key, "slug", "label", "score", "is_primary")


def speech_related_votes(speech: DataFrame, vote: DataFrame, limit: int = 10) -> DataFrame:
    """First votes on the bill of each speech; votes are cut per bill before they meet speeches."""
    v = R.top_n(vote.where(F.col("legislative_item").isNotNull()).select("legislative_item", "vote_id", "session_date", "title"),
                ["legislative_item"], [F.asc("session_date"), F.asc("vote_id")], limit)
    return speech.select("id", "legislative_item").join(v, "legislative_item").select("id", "rank", "vote_id", "session_date", "title")


def closest_votes(vote: DataFrame, limit: int = 12, min_side: int = 40) -> DataFrame:
    return (vote.where((F.col("is_procedural") == 0) & (F.col("result_yes") > min_side) & (F.col("result_no") > min_side))
            .withColumn("margin", F.abs(F.col("result_yes") - F.col("result_no")))
            .orderBy("margin", F.desc("session_date"), "vote_id").limit(limit)
            .select("vote_id", "vp_year", "title", "legislative_item", "result_yes", "result_no", "margin"))


def top_speakers(speech: DataFrame, limit: int = 12) -> DataFrame:
    return (speech.where(F.col("person_id").isNotNull()).groupBy("person_id")
            .agg(F.min("first_name").alias("first_name"), F.min("last_name").alias("last_name"), F.min("party").alias("party"), _n().alias("n"))
            .orderBy(F.desc("n"), "person_id").limit(limit))


def words_votes_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("alignment").agg(_n().alias("n"))


def words_votes_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.countDistinct("person_id").alias("n_persons"), F.countDistinct("legislative_item").alias("n_items"), _n().alias("n"))


def _priority(col: str = "alignment") -> Column:
    last = F.lit(len(C.ALIGNMENT_PRIORITY) - 1)
    return reduce(lambda e, iv: F.when(F.col(col) == iv[1], iv[0]).otherwise(e),
                  reversed(list(enumerate(C.ALIGNMENT_PRIORITY))), last)


def words_votes_examples(ledger: DataFrame, person: DataFrame, vote: DataFrame, limit: int = 24) -> DataFrame:
    """The strongest row per (member, bill) with the number of rows it stands for."""
    one = R.best_per_key(
        ledger.select("person_id", "legislative_item", "alignment", "speech_stance", "speech_quote", "speech_id",
                      "vote_id", "vote_value", "context_note", "confidence")
        .join(person.select("person_id", "full_name", "party_current"), "person_id", "left_semi"),
        ["person_id", "legislative_item"], [_priority(), -F.coalesce("confidence", F.lit(0.0)), F.col("vote_id")], "n_related")
    head = one.orderBy(_priority(), F.desc("confidence"), "vote_id", "person_id").limit(limit)
    return (head.join(person.select("person_id", "full_name", "party_current"), "person_id")
            .join(vote.select("vote_id", F.col("title").alias("vote_title"), "session_date"), "vote_id"))


def bill_explainer(explainer: DataFrame, legislation: DataFrame) -> DataFrame:
    leg = legislation.select(F.col("eduskunta_tunnus").alias("legislative_item"), F.col("title").alias("leg_title"),
                             F.col("summary").alias("leg_summary"), F.col("url").alias("leg_url"))
    return explainer.join(leg, "legislative_item", "left").withColumn(
        "sources", S.json_list(F.col("sources_json"), "struct<type:string,ref:string,quote:string>"))


def votes_for_item(vote: DataFrame) -> DataFrame:
    return vote.where(F.col("legislative_item").isNotNull()).select(
        "legislative_item", "vote_id", "session_date", "title", "result_yes", "result_no", "is_procedural")


ARGUMENT = "struct<argument:string,speaker:string,party:string,quote:string>"


def vote_proscons(proscons: DataFrame) -> DataFrame:
    """One row per argument of a vote, with its side and place."""
    def side(col, name):
        return proscons.select("vote_id", "note", F.lit(name).alias("side"),
                               F.posexplode_outer(S.json_list(F.col(col), ARGUMENT))) \
            .where(F.col("pos").isNotNull()).select("vote_id", "note", "side", "pos", "col.*")

    return side("pro_json", "pro").unionByName(side("con_json", "con"))


def item_stances(stance: DataFrame, person: DataFrame) -> DataFrame:
    """Most confident row per (bill, member, stance)."""
    s = stance.where(F.col("stance").isin(*C.STANCES)).select(
        "legislative_item", "person_id", "stance", "id", "proposition", "conditional_note", "evidence_quote", "speech_id", "confidence")
    one = R.best_per_key(s, ["legislative_item", "person_id", "stance"], [-F.coalesce("confidence", F.lit(0.0)), F.col("id")])
    return one.join(person.select("person_id", "full_name", "party_current"), "person_id")


def item_stance_counts(item_stance: DataFrame) -> DataFrame:
    return item_stance.groupBy("legislative_item", "stance").agg(_n().alias("n"))


def item_conflicts(ledger: DataFrame, person: DataFrame) -> DataFrame:
    """One conflicting or reluctant row per (bill, member)."""
    c = ledger.where(F.col("alignment").isin(C.CONFLICT, C.RELUCTANT)).select(
        "legislative_item", "person_id", "alignment", "speech_stance", "speech_quote", "speech_id", "vote_value", "context_note", "vote_id")
    one = R.best_per_key(c, ["legislative_item", "person_id"], [F.col("alignment"), F.col("vote_id")])
    return one.join(person.select("person_id", "full_name", "party_current"), "person_id")
