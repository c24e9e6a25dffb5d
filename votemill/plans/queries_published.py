"""Published result sets over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.operators import lines, maps, power, promises
from votemill.operators import published as P
from votemill.plans import bind
from votemill.plans.queries_blocks import PAIR_SQL, neighbour_pairs
from votemill.plans.queries_core import TALK_MAP, VOTE_MAP, political_map, r3, rhetoric_map
from votemill.plans.registry import query

SUM = "FROM member_summary JOIN person USING (person_id)"
AWARD_MIN = {"absent": 50, "rebel": 50, "loyal": 100, "words": 500}
TYPES = "struct<type:string,ref:string,quote:string>"


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


# --- members --------------------------------------------------------------------
RATED = {"speaking": "cast(n_speeches as double)", "presence": "CASE WHEN n_votes_total > 0 THEN 100.0::double * n_votes_cast / n_votes_total END",
         "topics": "cast(coalesce(br, 0) as double)", "experience": "cast(2025 - cast(substr(active_from, 1, 4) as int) as double)",
         "independence": "deviation_rate"}


@query("q_member_attributes", "WITH m AS (SELECT person_id, " + ", ".join(f"{e} AS {c}" for c, e in RATED.items())
       + " FROM member_summary JOIN person USING (person_id) LEFT JOIN (SELECT person_id, count(*) AS br FROM member_topic WHERE n_speeches > 0 GROUP BY 1) USING (person_id))"
       + " SELECT person_id, " + ", ".join(
           f"CASE WHEN {c} IS NOT NULL THEN cast(CASE WHEN count({c}) OVER () > 1 THEN round_even(1 + 98 * (row_number() OVER (ORDER BY {c} NULLS LAST, person_id) - 1) / (count({c}) OVER () - 1), 0) ELSE 50 END as int) END AS {c}"
           for c in RATED) + " FROM m")
def _(b):
    return P.member_attributes(b.member_summary, b.person, b.member_topic)


def awards(b):
    return P.awards(b.member_summary, b.person, b.word_usage, b.breakers, AWARD_MIN)


_ABS = "100.0::double * n_absent / n_votes_total"


def _leader(key, v, text, src, cond="true", order="DESC"):
    return (f"SELECT * FROM (SELECT '{key}' AS key, person_id, full_name, party_current, cast({v} as double) AS v, {text} AS value_text "
            f"FROM {src} WHERE {cond} AND {v} IS NOT NULL ORDER BY round(cast({v} as double), 9) {order}, person_id LIMIT 1)")


AWARDS_SQL = " UNION ALL ".join([
    _leader("speeches", "n_speeches", "printf('%d puhetta', n_speeches)", "member_summary JOIN person USING (person_id)"),
    _leader("absent", _ABS, f"printf('%.0f %% poissa', {_ABS})", "member_summary JOIN person USING (person_id)", "n_votes_total >= 50 AND is_minister = 0"),
    _leader("rebel", "100.0::double * deviation_rate", "printf('%.1f %% poikkeama', 100.0::double * deviation_rate)", "member_summary JOIN person USING (person_id)", "n_votes_eligible >= 50"),
    _leader("loyal", "100.0::double * deviation_rate", "printf('%.1f %% poikkeama', 100.0::double * deviation_rate)", "member_summary JOIN person USING (person_id)", "n_votes_eligible >= 100", "ASC"),
    *[_leader(c, "per_1000", "printf('%.2f / 1000 sanaa', per_1000)", "word_usage JOIN person USING (person_id)", f"category = '{c}' AND n_words >= 500") for c in ("filler", "swear")],
    "SELECT * FROM (SELECT 'flip' AS key, person_id, full_name, party_current, rate AS v, printf('%d/%d lupausta vastaan', against, eval) AS value_text FROM breaker ORDER BY rate DESC, eval DESC, person_id LIMIT 1)"])


@query("q_awards", f"SELECT key, person_id, full_name, party_current, round(v, 6) AS v, value_text FROM ({AWARDS_SQL})")
def _(b):
    return r6(awards(b), "v")


@query("q_award_holders", f"SELECT person_id, cast(count(*) as int) AS n_awards, string_agg(key, ',' ORDER BY key) AS awards FROM ({AWARDS_SQL}) GROUP BY 1")
def _(b):
    return P.award_holders(awards(b))


@query("q_index_highlights", """SELECT * FROM (SELECT 'spotlight' AS section, cast(person_id as varchar) AS id, full_name AS label, cast(n_votes_cast as bigint) AS n, tt AS detail, cast(consistency_index as bigint) AS value FROM member_summary JOIN person USING (person_id)
      LEFT JOIN (SELECT person_id, arg_min(label, (-n_speeches, topic_id)) AS tt FROM member_topic JOIN topic ON id = topic_id WHERE slug <> 'muu' AND n_speeches > 0 GROUP BY 1) USING (person_id)
      WHERE n_votes_eligible >= 50 ORDER BY md5(person_id || ':0'), person_id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'tight', cast(vote_id as varchar), title, cast(abs(result_yes - result_no) as bigint), legislative_item, cast(vp_year as bigint) FROM vote WHERE is_procedural = 0 AND result_yes > 3 AND result_no > 3
      ORDER BY vp_year DESC, abs(result_yes - result_no), vote_id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'trend', slug, label, count(*), NULL, NULL FROM speech s JOIN speech_topic st ON st.speech_id = s.id AND is_primary = 1 JOIN topic t ON t.id = st.topic_id WHERE slug <> 'muu'
      AND substr(started_at, 1, 4) = (SELECT max(substr(started_at, 1, 4)) FROM speech) GROUP BY t.id, slug, label ORDER BY count(*) DESC, t.id LIMIT 1)""")
def _(b):
    return P.index_highlights(b.member_summary, b.person, b.vote, b.speech, b.speech_topic, b.topic, b.member_topic, min_eligible=50, min_side=3)


@query("q_person_profile", """SELECT person_id, full_name, party_current, n_terms, term_list, n_groups, n_roles, consistency_index FROM person LEFT JOIN member_summary USING (person_id)
    LEFT JOIN (SELECT person_id, cast(count(*) as int) AS n_terms, string_agg(start_date || '/' || coalesce(end_date, ''), ',' ORDER BY start_date) AS term_list FROM person_term GROUP BY 1) USING (person_id)
    LEFT JOIN (SELECT person_id, cast(count(*) as int) AS n_groups FROM person_party GROUP BY 1) USING (person_id) LEFT JOIN (SELECT person_id, 1 AS n_roles FROM person WHERE is_minister = 1) USING (person_id)""")
def _(b):
    p = P.person_profile(b.person, b.person_party, b.person_term, b.person_role, b.member_summary)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return p.select("person_id", "full_name", "party_current", size("terms").alias("n_terms"), F.array_join(F.transform(
        "terms", lambda t: F.concat(t["start_date"], F.lit("/"), F.coalesce(t["end_date"], F.lit("")))), ",").alias("term_list"),
        size("parties").alias("n_groups"), size("minister_roles").alias("n_roles"), "consistency_index")


@query("q_person_topics", "SELECT person_id, slug, label, n_speeches, n_votes, n_speeches + n_votes AS total FROM member_topic JOIN topic ON id = topic_id WHERE n_speeches > 0 OR n_votes > 0")
def _(b):
    return P.person_topics(b.member_topic, b.topic)


@query("q_person_behavior", "SELECT person_id, vote_value, count(*) AS n FROM vote_record GROUP BY 1, 2")
def _(b):
    return P.person_behavior(b.vote_record)


@query("q_person_deviations", """SELECT person_id, cast(rank as int) AS rank, vote_id, party, member_value, party_line, session_date, title, legislative_item FROM (
    SELECT d.*, session_date, title, legislative_item, row_number() OVER (PARTITION BY person_id ORDER BY session_date DESC, vote_id) AS rank
    FROM party_deviation d JOIN vote USING (vote_id) WHERE classification = 'deviates') WHERE rank <= 25""")
def _(b):
    return P.person_deviations(b.party_deviation, b.vote_head)


@query("q_person_speeches", """SELECT person_id, id, ptk_id, speech_type, started_at, legislative_item, word_count, substr(text, 1, 200) AS preview, cast(rank as int) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY started_at DESC, id) AS rank FROM speech) WHERE rank <= 20""")
def _(b):
    return P.person_speeches(b.speech)


@query("q_person_changes", """SELECT person_id, item_base, stage, from_value, from_date, to_value, to_date, gap_days, label AS topic FROM position_change LEFT JOIN topic ON id = topic_id""")
def _(b):
    return P.person_changes(b.position_change, b.topic)


@query("q_person_recent_votes", """SELECT vote_id, person_id, r.vote_value, session_date, title, legislative_item, cast(rank as int) AS rank, party_line, classification FROM (
    SELECT vote_id, person_id, vote_value, session_date, title, legislative_item, row_number() OVER (PARTITION BY person_id ORDER BY session_date DESC, vote_id) AS rank
    FROM vote_record JOIN vote USING (vote_id)) r LEFT JOIN party_deviation d USING (vote_id, person_id) WHERE rank <= 20""")
def _(b):
    return P.person_recent_votes(b.vote_record, b.vote_head, b.party_deviation)


@query("q_person_word_style", """SELECT person_id, category, n_hits, n_words, per_1000, words FROM word_usage LEFT JOIN (
    SELECT person_id, category, string_agg(word || ':' || n, ',' ORDER BY rank) AS words FROM word_hits WHERE rank <= 6 GROUP BY 1, 2) USING (person_id, category)""")
def _(b):
    return P.person_word_style(b.word_usage, b.word_hits.drop("rank")).withColumn(
        "words", F.array_join(F.transform("top", lambda t: F.concat(t["word"], F.lit(":"), t["n"].cast("string"))), ",")).drop("top")


@query("q_person_words_votes", """SELECT person_id, w.legislative_item, speech_stance AS stance, speech_quote AS quote, speech_id, speech_date, vote_id, vote_value, alignment, context_note,
    title AS vote_title, session_date FROM words_votes w JOIN vote USING (vote_id)""")
def _(b):
    return P.person_words_votes(b.words_votes, b.vote_head)


@query("q_person_highlights", """WITH f AS (SELECT person_id, n_deviations, consistency_index, confidence_level, coalesce(ris, 0) AS ris, coalesce(vas, 0) AS vas, coalesce(ch, 0) AS ch FROM member_summary
      FULL JOIN (SELECT person_id, count(*) FILTER (alignment = 'ristiriita') AS ris, count(*) FILTER (alignment = 'vastentahtoinen') AS vas FROM words_votes GROUP BY 1) USING (person_id)
      FULL JOIN (SELECT person_id, count(*) AS ch FROM position_change GROUP BY 1) USING (person_id))
    SELECT person_id, 1 AS pos, printf('Äänesti %d kertaa eri tavalla kuin oma ryhmänsä enemmistö', n_deviations) AS text, '#aanet' AS anchor FROM f WHERE n_deviations > 0
    UNION ALL SELECT person_id, 2, printf('Johdonmukaisuusindeksi %d/100 (%s luottamus)', consistency_index, coalesce(confidence_level, '—')), '#indeksi' FROM f WHERE consistency_index IS NOT NULL
    UNION ALL SELECT person_id, 3, concat_ws(' · ', CASE WHEN ris > 0 THEN printf('%d puheen ja äänen ristiriita', ris) END, CASE WHEN vas > 0 THEN printf('%d vastentahtoinen ääni', vas) END) || ' kirjattu', '#sanat-aanet' FROM f WHERE ris > 0 OR vas > 0
    UNION ALL SELECT person_id, 4, printf('%d kannanmuutosta samasta säädöskohteesta', ch), '#muutokset' FROM f WHERE ch > 0""")
def _(b):
    return P.person_highlights(b.member_summary, b.words_votes, b.position_change)


@query("q_member_directory", f"""SELECT person_id, full_name, party_current, electoral_district, active_from, is_minister, n_speeches, n_votes_cast, n_votes_total, n_absent, n_votes_eligible,
    round(deviation_rate, 6) AS deviation_rate, consistency_index, confidence_level, CASE WHEN n_votes_total > 0 THEN round({_ABS}, 6) END AS absent_pct {SUM} WHERE n_votes_eligible >= 10""")
def _(b):
    return r6(P.member_directory(b.person, b.member_summary, sort="indeksi", descending=True, min_eligible=10), "deviation_rate", "absent_pct")


@query("q_list_persons", "SELECT person_id, full_name, party_current FROM person ORDER BY full_name, person_id")
def _(b):
    return b.person.select("person_id", "full_name", "party_current").orderBy("full_name", "person_id")


_RAD = [f"coalesce(max(m.n_speeches) FILTER (slug = '{s}'), 0)" for s in bind.RADAR]


@query("q_member_cards", f"""WITH d AS (SELECT person_id, full_name, is_minister, active_from, n_speeches, n_absent, n_votes_total {SUM}),
    r AS (SELECT person_id, [{', '.join(_RAD)}] AS ax FROM d LEFT JOIN member_topic m USING (person_id) LEFT JOIN topic t ON t.id = m.topic_id GROUP BY 1),
    tt AS (SELECT person_id, arg_min(label, (-n_speeches, topic_id)) AS top_topic FROM (SELECT m.person_id, t.label, m.n_speeches, m.topic_id FROM member_topic m JOIN topic t ON t.id = m.topic_id WHERE slug <> 'muu' AND m.n_speeches > 0) GROUP BY 1)
    SELECT person_id, full_name, array_to_string(list_transform(ax, lambda x: cast(cast(round(100 * x / greatest(list_max(ax), 1), 0) as int) as varchar)), ',') AS radar, top_topic,
      CASE WHEN is_minister = 1 THEN 'legendaarinen' WHEN n_speeches >= 400 OR cast(substr(active_from, 1, 4) as int) <= 2011 THEN 'harvinainen' ELSE 'perus' END AS rarity,
      concat_ws(',', CASE WHEN is_minister = 1 THEN 'Ministeri' END, CASE WHEN cast(substr(active_from, 1, 4) as int) <= 2011 THEN 'Konkari' END,
        CASE WHEN {_ABS} < 8 THEN 'Ahkera äänestäjä' END) AS traits FROM d LEFT JOIN r USING (person_id) LEFT JOIN tt USING (person_id)""")
def _(b):
    cards = P.member_cards(P.member_directory(b.person, b.member_summary), b.member_topic, b.topic, radar=bind.RADAR)
    return cards.select("person_id", "full_name", F.array_join(F.transform(
        "radar", lambda x: F.round(100 * x, 0).cast("int").cast("string")), ",").alias("radar"), "top_topic", "rarity", F.array_join("traits", ",").alias("traits"))


@query("q_compare", """WITH o AS (SELECT person_id, full_name, n_speeches, consistency_index, y, tp FROM person LEFT JOIN member_summary USING (person_id)
      LEFT JOIN (SELECT person_id, nullif(count(*) FILTER (vote_value = 'Jaa'), 0) AS y FROM vote_record GROUP BY 1) USING (person_id)
      LEFT JOIN (SELECT person_id, string_agg(slug || ':' || n_speeches || '/' || n_votes, ',' ORDER BY n_speeches + n_votes DESC, slug) AS tp FROM member_topic JOIN topic ON id = topic_id
        WHERE n_speeches > 0 OR n_votes > 0 GROUP BY 1) USING (person_id))
    SELECT a.person_id AS a, z.person_id AS b, a.full_name AS a_full_name, z.full_name AS b_full_name, a.n_speeches AS a_n_speeches, z.n_speeches AS b_n_speeches,
      a.consistency_index AS a_consistency_index, z.consistency_index AS b_consistency_index, a.y AS a_yes, z.y AS b_yes, a.tp AS a_topics, z.tp AS b_topics FROM o a JOIN o z ON z.person_id = a.person_id + 1 OR z.person_id = a.person_id + 2""")
def _(b):
    c = P.compare(neighbour_pairs(b), b.person, b.member_summary, P.person_behavior(b.vote_record), P.person_topics(b.member_topic, b.topic))

    def told(side):
        one = F.transform(f"{side}_topics", lambda t: F.concat(t["slug"], F.lit(":"), t["n_speeches"].cast("string"), F.lit("/"), t["n_votes"].cast("string")))
        return F.array_join(one, ",").alias(f"{side}_topics")

    return c.select("a", "b", "a_full_name", "b_full_name", "a_n_speeches", "b_n_speeches", "a_consistency_index", "b_consistency_index",
                    F.col("a_Jaa").alias("a_yes"), F.col("b_Jaa").alias("b_yes"), told("a"), told("b"))


@query("q_member_party_agreement", """SELECT person_id, l.party, count(*) FILTER (vote_value = line) AS agree, count(*) AS total, round(100.0::double * count(*) FILTER (vote_value = line) / count(*), 0) AS pct
    FROM vote_record r JOIN party_line l USING (vote_id) WHERE vote_value IN ('Jaa', 'Ei') AND line IN ('Jaa', 'Ei') GROUP BY 1, 2 HAVING count(*) >= 50""")
def _(b):
    return lines.member_party_agreement(b.vote_record, b.party_line)


@query("q_pair_agreement", "SELECT a, b, count(*) FILTER (va = vb) AS agree, count(*) AS total, round_even(100 * count(*) FILTER (va = vb) / count(*), 0) AS pct FROM ("
       + PAIR_SQL.format(cols="x.vote_value AS va, y.vote_value AS vb") + ") GROUP BY 1, 2")
def _(b):
    return lines.pair_agreement(b.vote_record, neighbour_pairs(b))


@query("q_all_pair_agreement", """SELECT x.person_id AS a, y.person_id AS b, count(*) FILTER (x.vote_value = y.vote_value) AS agree, count(*) AS total,
      round_even(100 * count(*) FILTER (x.vote_value = y.vote_value) / count(*), 0) AS pct
    FROM vote_record x JOIN vote_record y ON x.vote_id = y.vote_id AND x.person_id < y.person_id WHERE x.vote_value IN ('Jaa', 'Ei') AND y.vote_value IN ('Jaa', 'Ei') GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(b):
    return lines.all_pair_agreement(b.vote_record, 5)


@query("q_activity_scatter", f"""SELECT person_id, full_name, party_current, n_speeches, n_votes_cast, round({_ABS}, 6) AS absent_pct {SUM} WHERE n_votes_cast > 0""")
def _(b):
    return r6(P.activity_scatter(b.member_summary, b.person), "absent_pct")


@query("q_word_leaderboard", """SELECT person_id, full_name, party_current, per_1000, n_hits, n_words FROM word_usage JOIN person USING (person_id) WHERE category = 'filler' AND n_words >= 500
    ORDER BY per_1000 DESC, n_words DESC, person_id LIMIT 15""")
def _(b):
    return P.word_leaderboard(b.word_usage, b.person, "filler", min_words=500)


@query("q_word_zero_count", "SELECT category, count(*) FILTER (n_words >= 500 AND n_hits = 0) AS n_zero FROM word_usage GROUP BY 1")
def _(b):
    return P.word_zero_count(b.word_usage, 500)


# --- groups -----------------------------------------------------------------------
@query("q_party_members", """SELECT party_current, person_id, full_name, electoral_district, consistency_index, round(deviation_rate, 6) AS deviation_rate, confidence_level
    FROM person LEFT JOIN member_summary USING (person_id)""")
def _(b):
    return r6(P.party_members(b.person, b.member_summary), "deviation_rate")


@query("q_party_words", "SELECT party, rank, word, zscore, n_party, n_total FROM party_words WHERE rank <= 25")
def _(b):
    return P.party_word_list(b.party_words)


@query("q_all_party_top_words", "SELECT party, string_agg(word, ',' ORDER BY rank) AS words FROM party_words WHERE rank <= 6 GROUP BY 1")
def _(b):
    return P.party_top_words(b.party_words).withColumn("words", F.array_join("words", ","))


@query("q_party_overview", """SELECT party_current, party_current AS name, count(*) AS n, round(avg(consistency_index), 6) AS avg_idx, round(avg(deviation_rate), 6) AS avg_dev
    FROM person LEFT JOIN member_summary USING (person_id) GROUP BY 1""")
def _(b):
    return r6(P.party_overview(b.person, b.member_summary), "avg_idx", "avg_dev")


@query("q_parties", "SELECT party_current AS code, max(party_current_name) AS name, count(*) AS n FROM person GROUP BY 1")
def _(b):
    return P.parties(b.person)


@query("q_party_comparison", f"""SELECT party_current AS code, max(party_current_name) AS name, count(*) AS n_members, cast(sum(n_speeches) as bigint) AS speeches, round(avg(n_speeches), 0) AS avg_speeches,
    round(avg(consistency_index), 1) AS avg_idx, round(avg(deviation_rate) * 100, 2) AS avg_dev, round(avg(CASE WHEN n_votes_total > 0 THEN {_ABS} END), 1) AS avg_absent {SUM} GROUP BY 1 HAVING count(*) >= 3""")
def _(b):
    return P.party_comparison(b.person, b.member_summary)


COHESION_SQL = """SELECT party, count(*) AS eligible, count(*) FILTER (classification = 'deviates') AS deviations, round(100.0::double * count(*) FILTER (classification = 'deviates') / count(*), 2) AS pct
    FROM party_deviation WHERE classification IN ('follows', 'deviates') GROUP BY 1 HAVING count(*) >= 100"""


@query("q_party_cohesion", COHESION_SQL)
def _(b):
    return lines.party_cohesion(b.party_deviation, 100)


@query("q_party_covote_matrix", """WITH l AS (SELECT vote_id, party, line FROM party_line WHERE line IN ('Jaa', 'Ei')), c AS (SELECT party FROM l GROUP BY 1 HAVING count(*) >= 20)
    SELECT x.party AS party_a, y.party AS party_b, count(*) FILTER (x.line = y.line) AS agree, count(*) AS total, round_even(100 * count(*) FILTER (x.line = y.line) / count(*), 0) AS pct
    FROM l x JOIN l y ON x.vote_id = y.vote_id AND x.party <> y.party WHERE x.party IN (SELECT party FROM c) AND y.party IN (SELECT party FROM c) GROUP BY 1, 2""")
def _(b):
    return lines.party_covote(b.party_deviation, bind.GROUPS, 20)


@query("q_power_overview", """SELECT party, max(win_pct) FILTER (status = 'gov') AS gov_pct, max(n_votes) FILTER (status = 'gov') AS gov_n, max(win_pct) FILTER (status = 'opp') AS opp_pct,
    max(n_votes) FILTER (status = 'opp') AS opp_n FROM power_effect GROUP BY 1 HAVING sum(n_votes) >= 100""")
def _(b):
    return P.power_overview(power.power_effect(b.outcomes, 10), 100)


@query("q_power_lost", "SELECT vote_id, abs(c.result_yes - c.result_no) AS margin, c.vp_year, title, legislative_item, c.result_yes, c.result_no FROM coalition c JOIN vote USING (vote_id) WHERE NOT won")
def _(b):
    return P.lost_votes(power.coalition_lost(power.coalition_votes(b.outcomes)), b.vote)


@query("q_promises", "SELECT id, scope, party_code, person_id, text FROM promise")
def _(b):
    return b.promise.orderBy("party_code", "id")


@query("q_promise_mappings", "SELECT promise_id, m.vote_id, expected_value, rationale, source_note, curated_by, mapping_version, title, session_date, legislative_item FROM promise_vote_map m JOIN vote USING (vote_id)")
def _(b):
    return b.promise_vote_map.join(b.vote_head.select("vote_id", "title", "session_date", "legislative_item"), "vote_id")


@query("q_promise_broken", "SELECT promise_id, party_code, n_met, n_votes FROM promise_result WHERE kept = 0")
def _(b):
    return promises.party_promise_results(b.promise, b.promise_vote_map, b.party_line, b.vote_head).where("kept = 0").drop("kept")


@query("q_survey_statements", "SELECT DISTINCT statement_id, 'statement number ' || statement_id || ' of the survey' AS text FROM survey_long")
def _(b):
    """Statements that got answers, with their text."""
    from votemill.operators import survey
    ids = {c: i for i, c in enumerate(bind.STATEMENT_FACTORS, 1)}
    names = b.spark.createDataFrame([(i, c) for c, i in ids.items()], "statement_id int, text string")
    return survey.unpivot_answers(b.survey_wide, "puolue", ids).select("statement_id").distinct().join(names, "statement_id")


@query("q_survey_stance", "SELECT party, party_code, mean, n, agree_pct FROM survey_stance WHERE statement_id = 2 AND party_code IS NOT NULL")
def _(b):
    return b.survey_stance.where("statement_id = 2 AND party_code IS NOT NULL").select("party", "party_code", "mean", "n", "agree_pct").orderBy(F.desc("mean"))


# --- maps -------------------------------------------------------------------------
POINTS_SQL = """SELECT 'member' AS kind, person_id, full_name, party, round(dim1, 3) AS dim1, round(dim2, 3) AS dim2, NULL::bigint AS n_members FROM pts JOIN person USING (person_id)
    UNION ALL SELECT 'centroid', NULL, NULL, party, round(cx, 3), round(cy, 3), n_members FROM mid"""


@query("q_map_points", VOTE_MAP + POINTS_SQL)
def _(b):
    return r3(maps.with_centroids(political_map(b), b.person))


@query("q_mavericks", VOTE_MAP + """SELECT person_id, full_name, party, round(dim1, 3) AS dim1, round(dim2, 3) AS dim2, nearest_party, round(dist_own, 3) AS dist_own
    FROM near JOIN person USING (person_id) WHERE dist_own IS NOT NULL ORDER BY near.dist_own DESC, person_id LIMIT 15""")
def _(b):
    m = political_map(b).join(b.person.select("person_id", "full_name"), "person_id")
    return r3(m.where("dist_own IS NOT NULL").orderBy(F.desc("dist_own"), "person_id").limit(15)
              .select("person_id", "full_name", "party", "dim1", "dim2", "nearest_party", "dist_own"))


@query("q_party_outsiders", VOTE_MAP + """SELECT person_id, full_name, party, nearest_party, round(dist_own, 3) AS dist_own FROM near JOIN person USING (person_id)
    WHERE nearest_party IS NOT NULL AND nearest_party <> party""")
def _(b):
    m = political_map(b).join(b.person.select("person_id", "full_name"), "person_id")
    return r3(m.where("nearest_party IS NOT NULL AND nearest_party <> party").orderBy(F.desc("dist_own"))
              .select("person_id", "full_name", "party", "nearest_party", "dist_own"))


@query("q_rhetoric_points", TALK_MAP + POINTS_SQL)
def _(b):
    return r3(maps.with_centroids(rhetoric_map(b), b.person))


@query("q_rhetoric_mismatch", TALK_MAP + """SELECT person_id, full_name, party, nearest_party, round(dim1, 3) AS dim1, round(dim2, 3) AS dim2 FROM near JOIN person USING (person_id)
    WHERE nearest_party <> party ORDER BY full_name, person_id LIMIT 25""")
def _(b):
    m = rhetoric_map(b).join(b.person.select("person_id", "full_name"), "person_id")
    return r3(m.where("nearest_party <> party").orderBy("full_name", "person_id").limit(25)
              .select("person_id", "full_name", "party", "nearest_party", "dim1", "dim2"))


# --- topics -----------------------------------------------------------------------
@query("q_topics", """SELECT t.id AS topic_id, slug, label, coalesce(s, 0) AS n_speeches, coalesce(v, 0) AS n_votes FROM topic t LEFT JOIN (SELECT topic_id, count(*) AS s FROM speech_topic GROUP BY 1) a ON a.topic_id = t.id
    LEFT JOIN (SELECT topic_id, count(*) AS v FROM vote_topic GROUP BY 1) c ON c.topic_id = t.id WHERE slug <> 'muu'""")
def _(b):
    return P.topics(b.topic, b.speech_topic, b.vote_topic)


@query("q_topic_detail", """SELECT topic_id, cast(rank as int) AS rank, speech_id, score, first_name, last_name, party, started_at, substr(text, 1, 160) AS preview FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, speech_id) AS rank FROM speech_topic) JOIN speech ON id = speech_id WHERE rank <= 30""")
def _(b):
    return P.topic_top_speeches(b.speech, b.speech_topic)


@query("q_topic_detail_votes", """SELECT topic_id, vote_id, score, session_date, title, legislative_item, cast(rank as int) AS rank FROM (
    SELECT topic_id, vote_id, score, session_date, title, legislative_item, row_number() OVER (PARTITION BY topic_id ORDER BY session_date DESC, vote_id) AS rank FROM vote_topic JOIN vote USING (vote_id)) WHERE rank <= 30""")
def _(b):
    return P.topic_latest_votes(b.vote_head, b.vote_topic)


@query("q_topic_detail_speakers", """SELECT topic_id, person_id, first_name, last_name, party, n, cast(rank as int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, person_id) AS rank FROM (
    SELECT topic_id, person_id, min(first_name) AS first_name, min(last_name) AS last_name, min(party) AS party, count(*) AS n FROM speech_topic JOIN speech ON id = speech_id GROUP BY 1, 2)) WHERE rank <= 10""")
def _(b):
    return P.topic_top_speakers(b.speech, b.speech_topic)


@query("q_topic_trends", """SELECT t.id AS topic_id, slug, y AS year, coalesce(n, 0) AS n FROM topic t CROSS JOIN (SELECT cast(unnest(range(1995, 2002)) as int) AS y) LEFT JOIN (
    SELECT topic_id, cast(substr(started_at, 1, 4) as int) AS y, count(*) AS n FROM speech_topic JOIN speech ON id = speech_id WHERE is_primary = 1 GROUP BY 1, 2) c ON c.topic_id = t.id AND c.y = y WHERE slug <> 'muu'""".replace("c.y = y", "c.y = yy").replace("AS y) LEFT", "AS yy) LEFT").replace("slug, y AS year", "slug, yy AS year"))
def _(b):
    return P.topic_trends(b.speech, b.speech_topic, b.topic, bind.YEARS)


@query("q_topic_ownership", """SELECT topic_id, slug, year, party, n, round_even(100 * n / CASE WHEN tot = 0 THEN 1 ELSE tot END, 1) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY topic_id, year) AS tot FROM (
    SELECT t.id AS topic_id, slug, yy AS year, g AS party, coalesce(n, 0) AS n FROM topic t CROSS JOIN (SELECT cast(unnest(range(1995, 2002)) as int) AS yy) CROSS JOIN (VALUES ('EUROPE'), ('ASIA'), ('AFRICA'), ('muut')) p(g)
    LEFT JOIN (SELECT topic_id, cast(substr(started_at, 1, 4) as int) AS y, CASE WHEN party IN ('EUROPE', 'ASIA', 'AFRICA') THEN party ELSE 'muut' END AS pp, count(*) AS n
      FROM speech_topic JOIN speech ON id = speech_id WHERE is_primary = 1 GROUP BY 1, 2, 3) c ON c.topic_id = t.id AND c.y = yy AND c.pp = g))""")
def _(b):
    return P.topic_ownership(b.speech, b.speech_topic, b.topic, years=bind.YEARS, parties=("EUROPE", "ASIA", "AFRICA"))


@query("q_topic_timeline", """SELECT legislative_item, vote_id, session_date, title, result_yes, result_no, topic_id, cast(rank as int) AS rank,
    CASE WHEN legislative_item IN (SELECT legislative_item FROM explainer) THEN 1 ELSE 0 END AS has_explainer FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY session_date, vote_id) AS rank
    FROM vote JOIN vote_topic USING (vote_id) WHERE is_procedural = 0) WHERE rank <= 40""")
def _(b):
    return P.topic_timeline(b.vote, b.vote_topic, b.explainer)


# --- votes, speeches, bills -----------------------------------------------------------
@query("q_vote_detail", """SELECT vote_id, 'vote' AS section, NULL AS party, NULL AS person_id, title AS value, result_total AS n FROM vote
    UNION ALL SELECT vote_id, 'record', coalesce(party, '(tuntematon)'), person_id, vote_value, NULL FROM vote_record
    UNION ALL SELECT vote_id, 'party', party, NULL, value, count(*) FILTER (vote_value = value) FROM vote_record, (VALUES ('Jaa'), ('Ei'), ('Tyhjää'), ('Poissa')) k(value) GROUP BY vote_id, party, value""")
def _(b):
    return P.vote_detail(b.vote, b.vote_record)


@query("q_vote_topics", "SELECT vote_id, slug, label, score, is_primary FROM vote_topic JOIN topic ON id = topic_id")
def _(b):
    return P.item_topics(b.vote_topic, b.topic, "vote_id")


@query("q_speech_detail", "SELECT speech_id, slug, label, score, is_primary FROM speech_topic JOIN topic ON id = topic_id")
def _(b):
    return P.item_topics(b.speech_topic, b.topic, "speech_id")


@query("q_speech_related_votes", """SELECT s.id, cast(rank as int) AS rank, vote_id, session_date, title FROM speech s JOIN (
    SELECT legislative_item, vote_id, session_date, title, row_number() OVER (PARTITION BY legislative_item ORDER BY session_date, vote_id) AS rank FROM vote) v USING (legislative_item) WHERE rank <= 10""")
def _(b):
    return P.speech_related_votes(b.speech, b.vote_head)


@query("q_closest_votes", """SELECT vote_id, vp_year, title, legislative_item, result_yes, result_no, abs(result_yes - result_no) AS margin FROM vote
    WHERE is_procedural = 0 AND result_yes > 3 AND result_no > 3 ORDER BY abs(result_yes - result_no), session_date DESC, vote_id LIMIT 12""")
def _(b):
    return P.closest_votes(b.vote, min_side=3)


@query("q_top_speakers", "SELECT person_id, min(first_name) AS first_name, min(last_name) AS last_name, min(party) AS party, count(*) AS n FROM speech GROUP BY 1 ORDER BY n DESC, person_id LIMIT 12")
def _(b):
    return P.top_speakers(b.speech)


@query("q_words_votes_overview", """SELECT person_id, legislative_item, alignment, speech_stance, vote_id, vote_value, confidence, n_related, full_name FROM (SELECT *,
      count(*) OVER (PARTITION BY person_id, legislative_item) AS n_related, row_number() OVER (PARTITION BY person_id, legislative_item ORDER BY pr, confidence DESC, vote_id) AS rn FROM (
      SELECT *, CASE alignment WHEN 'ristiriita' THEN 0 WHEN 'vastentahtoinen' THEN 1 WHEN 'linjassa' THEN 2 WHEN 'konteksti' THEN 3 ELSE 4 END AS pr FROM words_votes)) JOIN person USING (person_id)
    WHERE rn = 1 ORDER BY pr, confidence DESC, vote_id, person_id LIMIT 24""")
def _(b):
    return P.words_votes_examples(b.words_votes, b.person, b.vote_head).select(
        "person_id", "legislative_item", "alignment", "speech_stance", "vote_id", "vote_value", "confidence", "n_related", "full_name")


@query("q_words_votes_counts", "SELECT alignment, count(*) AS n FROM words_votes GROUP BY 1")
def _(b):
    return P.words_votes_counts(b.words_votes)


@query("q_words_votes_totals", "SELECT count(DISTINCT person_id) AS n_persons, count(DISTINCT legislative_item) AS n_items, count(*) AS n FROM words_votes")
def _(b):
    return P.words_votes_totals(b.words_votes)


@query("q_bill_explainer", """SELECT e.legislative_item, what_changes, who_affected, l.title AS leg_title, l.url AS leg_url, ref, quote FROM explainer e LEFT JOIN legislation l ON l.eduskunta_tunnus = e.legislative_item""")
def _(b):
    return P.bill_explainer(b.explainer, b.legislation).select(
        "legislative_item", "what_changes", "who_affected", "leg_title", "leg_url", F.inline("sources")).drop("type")


@query("q_votes_for_item", "SELECT legislative_item, vote_id, session_date, title, result_yes, result_no, is_procedural FROM vote")
def _(b):
    return P.votes_for_item(b.vote)


@query("q_vote_proscons", """SELECT v.vote_id, 'n' AS note, CASE side WHEN 'for' THEN 'pro' ELSE 'con' END AS side, 0 AS pos, side AS argument, first_name || ' ' || last_name AS speaker, party, CASE side WHEN 'for' THEN q_for ELSE q_against END AS quote
    FROM vote v JOIN bill_speech s ON s.legislative_item = v.legislative_item AND nth_last = 1 CROSS JOIN (VALUES ('for'), ('against')) a(side)""")
def _(b):
    return P.vote_proscons(b.proscons)


ITEM_STANCE_SQL = """SELECT s.person_id, legislative_item, stance, id, proposition, evidence_quote, speech_id, confidence, full_name, party_current FROM (SELECT *,
    row_number() OVER (PARTITION BY legislative_item, person_id, stance ORDER BY confidence DESC, id) AS rn FROM stance) s JOIN person USING (person_id) WHERE rn = 1"""


@query("q_item_stances", ITEM_STANCE_SQL)
def _(b):
    return P.item_stances(b.stance, b.person).drop("conditional_note")


@query("q_item_stance_counts", f"SELECT legislative_item, stance, count(*) AS n FROM ({ITEM_STANCE_SQL}) GROUP BY 1, 2")
def _(b):
    return P.item_stance_counts(P.item_stances(b.stance, b.person))


@query("q_item_conflicts", """SELECT person_id, legislative_item, alignment, speech_stance, speech_quote, speech_id, vote_value, context_note, vote_id, full_name, party_current FROM (SELECT *,
    row_number() OVER (PARTITION BY legislative_item, person_id ORDER BY alignment, vote_id) AS rn FROM words_votes WHERE alignment IN ('ristiriita', 'vastentahtoinen')) JOIN person USING (person_id) WHERE rn = 1""")
def _(b):
    return P.item_conflicts(b.words_votes, b.person)
