"""Analytic operators: topics, lines, members, language, power, maps, stance, promises, survey, search, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from votemill.functions import text as X
from votemill.operators import coverage, language, maps, members, postings, power, promises, search, stance, topics
from votemill.plans import bind
from votemill.plans.registry import ORACLES, query
from votemill.runtime import fresh_path, saved

SIX = 6


# --- topics -------------------------------------------------------------------
@query("topic_assign", "SELECT speech_id, topic_id, score, is_primary, status FROM speech_topic")
def _(b):
    return b.speech_topic


@query("topic_classify_all", "SELECT item_type, item_id, topic_id, score, is_primary, status FROM item_topic")
def _(b):
    return topics.classify_all(b.speech_text, b.vote_head, b.legislation, bind.LEXICON)


@query("topic_seed", """SELECT k.topic_id, t.slug, t.label, trim(p1 || ' ' || p2) AS keyword, cast(weight as double) AS weight, count(DISTINCT item_id) AS n_speeches
    FROM topic_keyword k JOIN topic t ON t.id = k.topic_id JOIN item_pos i ON i.item_type = 'speech' AND starts_with(t1, p1) AND (p2 = '' OR starts_with(coalesce(t2, ''), p2))
    GROUP BY 1, 2, 3, 4, 5""")
def _(b):
    """The seeded lexicon tables with the number of speeches each keyword occurs in."""
    topic, keyword = topics.topic_tables(b.spark, bind.LEXICON)
    line = X.token_line(F.col("text"))
    pairs = [(i, k) for i, _, _, kws in bind.LEXICON for k, _ in kws]
    counts = b.speech.select(line.alias("l")).agg(
        *[F.count_if(X.prefix_count(F.col("l"), k) > 0).alias(f"c{j}") for j, (_, k) in enumerate(pairs)])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("topic_id"), F.lit(k).alias("keyword"), F.col(f"c{j}").alias("n_speeches"))
                                            for j, (i, k) in enumerate(pairs)])))
    return (keyword.join(long, ["topic_id", "keyword"]).join(topic.withColumnRenamed("id", "topic_id"), "topic_id")
            .where("n_speeches > 0"))


# --- lines --------------------------------------------------------------------
@query("party_line", "SELECT vote_id, party, line FROM party_line")
def _(b):
    return b.party_line


@query("party_deviation", "SELECT person_id, vote_id, party, member_value, party_line, classification FROM party_deviation")
def _(b):
    return b.party_deviation


# --- members ------------------------------------------------------------------
@query("speech_vote_alignment", "SELECT person_id, n_pairs, n_near, round(a, 6) AS alignment FROM alignment")
def _(b):
    return members.speech_vote_alignment(b.topic_days).withColumn("alignment", F.round("alignment", SIX))


@query("member_summary", """SELECT person_id, period, n_votes_total, n_votes_eligible, n_deviations, round(deviation_rate, 6) AS deviation_rate, n_votes_cast, n_absent,
    n_speeches, speech_vote_alignment, party_line_score, consistency_index, confidence_score, confidence_level, flags FROM member_summary""")
def _(b):
    return b.member_summary.withColumn("deviation_rate", F.round("deviation_rate", SIX))


@query("party_line_by_loads", ORACLES["party_line"])
def _(b):
    return b.by_loads.party_line()


@query("party_deviation_by_loads", ORACLES["party_deviation"])
def _(b):
    return b.by_loads.party_deviation()


@query("member_summary_by_loads", ORACLES["member_summary"])
def _(b):
    return b.by_loads.member_summary(b.person).withColumn("deviation_rate", F.round("deviation_rate", SIX))


@query("member_topic_counts", "SELECT person_id, topic_id, n_speeches, n_votes FROM member_topic")
def _(b):
    return b.member_topic


@query("position_change", "SELECT person_id, topic_id, item_base, stage, from_value, from_date, to_value, to_date, gap_days FROM position_change")
def _(b):
    return b.position_change.drop("note")


# --- language -----------------------------------------------------------------
@query("party_token_counts", "SELECT party, word, n FROM party_tokens")
def _(b):
    return language.party_token_counts(b.speech, bind.STOPWORDS)


@query("party_distinctive_words", "SELECT party, word, zscore, n_party, n_total, rank FROM party_words")
def _(b):
    return b.party_words


@query("word_style", "SELECT person_id, category, n_hits, n_words, per_1000 FROM word_usage")
def _(b):
    return b.word_usage


# --- power and maps -------------------------------------------------------------
@query("power_effect", "SELECT party, status, n_votes, win_pct FROM power_effect")
def _(b):
    return power.power_effect(b.outcomes, min_votes=10)


@query("gov_winrate", """SELECT vp_year, count(*) AS n_votes, count(*) FILTER (won) AS gov_wins, round_even(100 * count(*) FILTER (won) / count(*), 1) AS pct
    FROM coalition GROUP BY 1""")
def _(b):
    return power.coalition_winrate(power.coalition_votes(b.outcomes))


@query("gov_lost", "SELECT vote_id, abs(result_yes - result_no) AS margin FROM coalition WHERE NOT won")
def _(b):
    return power.coalition_lost(power.coalition_votes(b.outcomes))


MAP = dict(left="EUROPE", right="ASIA", up="AFRICA")


def political_map(b) -> DataFrame:
    def drawn(path: str) -> DataFrame:
        out = maps.political_map(b.vote_record, b.vote_head, b.person, years=bind.YEARS, min_votes=50, **MAP)
        if out is None:
            raise ValueError("too few votes or members for a map")
        return saved(out, path)

    return b.once("political-map", drawn)


def rhetoric_map(b) -> DataFrame:
    def drawn(path: str) -> DataFrame:
        out = maps.rhetoric_map(b.embedding, b.person, dim=64, min_speeches=20, **MAP)
        if out is None:
            raise ValueError("too few members for a map")
        return saved(out, path)

    return b.once("rhetoric-map", drawn)


def _top_axis(matrix: str, name: str) -> str:
    """Views ``{name}_v`` (unit vector) and ``{name}_l`` (value) of the largest eigenvector of a view ``matrix(m)``, by repeated squaring."""
    return f"""{name}_p AS (SELECT 0 AS k, list_transform(m, lambda r: list_transform(r, lambda x: x / t)) AS m FROM (SELECT m, list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS t FROM {matrix})
      UNION ALL SELECT k + 1, list_transform(m2, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(range(1, len(m2) + 1), lambda i: m2[i][i])))) FROM
        (SELECT k, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS m2 FROM {name}_p WHERE k < 16)),
    {name}_v AS (SELECT list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM (SELECT m[list_position(d, list_max(d))] AS c FROM (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {name}_p WHERE k = 16))),
    {name}_l AS (SELECT list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM {name}_v, {matrix})"""


def _placed(raw: str, tail: str = "") -> str:
    """Views ``pts`` (signs fixed by group means, both axes on [-100, 100]), ``mid`` (centres) and ``near`` from a view ``raw(person_id, party, x, y)``."""
    g = MAP
    return f"""sgn AS (SELECT CASE WHEN coalesce(avg(x) FILTER (party = '{g['left']}'), 0) > coalesce(avg(x) FILTER (party = '{g['right']}'), 0) THEN -1.0::double ELSE 1.0::double END AS sx,
      CASE WHEN coalesce(avg(y) FILTER (party = '{g['up']}'), 0) < 0 THEN -1.0::double ELSE 1.0::double END AS sy FROM {raw}),
    flip AS (SELECT r.* REPLACE (x * sx AS x, y * sy AS y) FROM {raw} r, sgn),
    pts AS (SELECT * EXCLUDE (x, y), CASE WHEN max(x) OVER () > min(x) OVER () THEN 200 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) - 100 ELSE x END AS dim1,
      CASE WHEN max(y) OVER () > min(y) OVER () THEN 200 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) - 100 ELSE y END AS dim2 FROM flip),
    mid AS (SELECT party, avg(dim1) AS cx, avg(dim2) AS cy, count(*) AS n_members FROM pts GROUP BY 1 HAVING count(*) >= 3),
    near AS (SELECT p.*, (SELECT arg_min(m.party, (pow(dim1 - cx, 2) + pow(dim2 - cy, 2), m.party)) FROM mid m) AS nearest_party,
      (SELECT sqrt(pow(dim1 - cx, 2) + pow(dim2 - cy, 2)) FROM mid m WHERE m.party = p.party) AS dist_own FROM pts p)"""


VOTE_MAP = f"""WITH RECURSIVE cell AS (SELECT person_id, vote_id, CASE vote_value WHEN 'Jaa' THEN 1.0::double ELSE -1.0::double END AS x FROM vote_record JOIN vote USING (vote_id)
      WHERE is_procedural = 0 AND vote_value IN ('Jaa', 'Ei') AND vp_year IN {bind.YEARS}),
    mem AS (SELECT person_id, count(*) AS n_votes, row_number() OVER (ORDER BY person_id) AS i FROM cell GROUP BY 1 HAVING count(*) >= 50),
    used AS (SELECT vote_id, i, x FROM cell JOIN mem USING (person_id)), nn AS (SELECT count(*) AS n FROM mem),
    mean AS (SELECT vote_id, sum(x) / any_value(n) AS mu FROM used, nn GROUP BY 1),
    bi AS (SELECT i, sum(x * mu) AS b FROM used JOIN mean USING (vote_id) GROUP BY 1), c0 AS (SELECT sum(mu * mu) AS c FROM mean),
    ai AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM used a JOIN used b USING (vote_id) GROUP BY 1, 2),
    gm AS (SELECT list(r ORDER BY i) AS m FROM (SELECT p.i, list(coalesce(s, 0) - bp.b - bq.b + c ORDER BY q.i) AS r FROM mem p CROSS JOIN mem q CROSS JOIN c0
      JOIN bi bp ON bp.i = p.i JOIN bi bq ON bq.i = q.i LEFT JOIN ai ON ai.i = p.i AND ai.j = q.i GROUP BY p.i)),
    {_top_axis('gm', 'e1')},
    gd AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM gm, e1_v, e1_l),
    {_top_axis('gd', 'e2')},
    raw AS (SELECT person_id, coalesce(party_current, '?') AS party, n_votes, e1_v.v[i] * sqrt(e1_l.l) AS x, e2_v.v[i] * sqrt(e2_l.l) AS y,
      cast(round_even(100 * e1_l.l / tr, 0) as int) AS var1, cast(round_even(100 * e2_l.l / tr, 0) as int) AS var2
      FROM mem LEFT JOIN person USING (person_id), e1_v, e1_l, e2_v, e2_l, (SELECT list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS tr FROM gm)),
    {_placed('raw')}
    """
TALK_MAP = f"""WITH RECURSIVE sp AS (SELECT vec_id % (SELECT count(*) // 20 FROM embeddings) AS person_id, embedding FROM embeddings),
    mv AS (SELECT person_id, list(a ORDER BY k) AS mean FROM (SELECT person_id, k, avg(cast(embedding[k] as double)) AS a, count(*) AS n FROM sp, range(1, 65) t(k) GROUP BY 1, 2) WHERE n >= 20 GROUP BY 1),
    un AS (SELECT person_id, party_current AS party, list_transform(mean, lambda e: e / (sqrt(list_dot_product(mean, mean)) + 1e-9::double)) AS u FROM mv JOIN person USING (person_id) WHERE party_current IS NOT NULL),
    ct AS (SELECT list(a ORDER BY k) AS c FROM (SELECT k, avg(u[k]) AS a FROM un, range(1, 65) t(k) GROUP BY 1)),
    cn AS (SELECT person_id, party, list_transform(range(1, 65), lambda k: u[k] - c[k]) AS d FROM un, ct),
    gm AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, sum(d[i] * d[j]) AS s FROM cn, range(1, 65) a(i), range(1, 65) b(j) GROUP BY 1, 2) GROUP BY 1)),
    {_top_axis('gm', 'e1')},
    gd AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM gm, e1_v, e1_l),
    {_top_axis('gd', 'e2')},
    raw AS (SELECT person_id, party, list_dot_product(d, e1_v.v) AS x, list_dot_product(d, e2_v.v) AS y FROM cn, e1_v, e2_v),
    {_placed('raw')}
    """


def r3(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 3) for c in ("dim1", "dim2", "dist_own") if c in df.columns})


@query("political_map", VOTE_MAP + f"""SELECT person_id, party, n_votes, var1, var2, round(dim1, 3) AS dim1, round(dim2, 3) AS dim2, nearest_party, round(dist_own, 3) AS dist_own,
    '{bind.YEARS[0]}–{bind.YEARS[-1]}' AS period FROM near""")
def _(b):
    return r3(political_map(b))


@query("rhetoric_map", TALK_MAP + "SELECT person_id, party, round(dim1, 3) AS dim1, round(dim2, 3) AS dim2, nearest_party FROM near")
def _(b):
    return r3(rhetoric_map(b))


# --- stance -------------------------------------------------------------------
@query("stance_candidates", """SELECT id, person_id, legislative_item, text, started_at FROM speech
    WHERE person_id IS NOT NULL AND length(text) > 200 AND legislative_item IN (SELECT legislative_item FROM vote)""")
def _(b):
    return stance.stance_candidates(b.speech, b.vote_head)


@query("stance_from_extractions", """SELECT id AS speech_id, person_id, legislative_item, 'a' AS proposition, 'puolesta' AS stance,
      substr(text, 1, 30) AS evidence_quote, cast(id % 10 as double) / 10 AS confidence, 'x' AS model FROM speech WHERE id % 2 = 0
    UNION ALL SELECT speech_id, person_id, legislative_item, proposition, stance, evidence_quote, confidence, model FROM stance WHERE speech_id % 2 <> 0""")
def _(b):
    ok = ("named_struct('proposition', 'a', 'stance', 'puolesta', 'conditional_note', null, 'evidence_quote', substring(text, 1, 30), "
          "'confidence', cast(id % 10 as double) / 10)")
    bad = ok.replace("'puolesta'", "'joku'")
    unquoted = ok.replace("substring(text, 1, 30)", "''")
    ext = b.speech.where("id % 2 = 0").selectExpr(
        "id AS speech_id", f"to_json(named_struct('propositions', array({ok}, {bad}, {unquoted}))) AS response_json", "'x' AS model")
    return stance.stance_from_extractions(ext, b.speech, b.stance).drop("conditional_note")


@query("explain_candidates", """SELECT l.eduskunta_tunnus AS legislative_item, l.title, substr(l.summary, 1, 3000) AS summary, coalesce(d.debate, '') AS debate
    FROM legislation l LEFT JOIN (SELECT legislative_item, string_agg(first_name || ' ' || last_name || ' (' || party || '): ' || substr(text, 1, 700), chr(10) || chr(10) ORDER BY rn) AS debate
      FROM (SELECT *, row_number() OVER (PARTITION BY legislative_item ORDER BY length(text) DESC, id) AS rn FROM speech WHERE length(text) > 300) WHERE rn <= 8 GROUP BY 1) d
      ON d.legislative_item = l.eduskunta_tunnus
    WHERE length(l.summary) > 120 AND l.eduskunta_tunnus IN (SELECT legislative_item FROM vote)""")
def _(b):
    return stance.explain_candidates(b.legislation, b.vote_head, b.speech)


@query("dominant_stance", """SELECT d.person_id, d.legislative_item, dominant, stance_id, s.speech_id, s.evidence_quote, s.confidence, s.model
    FROM dominant d JOIN stance s ON s.id = d.stance_id""")
def _(b):
    return stance.dominant_stance(b.stance)


@query("words_votes_ledger", """SELECT person_id, vote_id, speech_id, legislative_item, speech_stance, speech_quote, speech_date, vote_value, vote_date, vote_stage,
    alignment, context_note, confidence, model FROM words_votes""")
def _(b):
    return b.words_votes


# --- promises and survey ----------------------------------------------------------
@query("promise_member_alignment", """SELECT promise_id, person_id, s AS n_support, c AS n_conflict, u AS n_unclear, CASE WHEN s + c + u = 0 THEN 1 ELSE 0 END AS unmapped,
    CASE WHEN s + c + u = 0 THEN 'ei kartoitettu' WHEN s + c = 0 THEN 'epäselvä' WHEN c = 0 THEN 'tukee' WHEN s = 0 THEN 'ristiriidassa' ELSE 'epäselvä (ristiriitainen)' END AS alignment
    FROM (SELECT p.id AS promise_id, m.person_id, count(*) FILTER (pm.vote_id IS NOT NULL AND vote_value IN ('Jaa', 'Ei') AND vote_value = expected_value) AS s,
      count(*) FILTER (pm.vote_id IS NOT NULL AND vote_value IN ('Jaa', 'Ei') AND vote_value <> expected_value) AS c,
      count(*) FILTER (pm.vote_id IS NOT NULL AND (vote_value IS NULL OR vote_value IN ('Tyhjää', 'Poissa'))) AS u
      FROM promise p JOIN person m ON NOT (p.scope = 'party' AND p.party_code IS NOT NULL AND p.party_code <> m.party_current)
        AND NOT (p.scope = 'person' AND p.person_id IS NOT NULL AND p.person_id <> m.person_id)
      LEFT JOIN promise_vote_map pm ON pm.promise_id = p.id LEFT JOIN vote_record r ON r.vote_id = pm.vote_id AND r.person_id = m.person_id GROUP BY 1, 2)""")
def _(b):
    return promises.member_alignment(b.promise, b.promise_vote_map, b.vote_record, b.person, b.vote_head)


@query("promise_keeping_party", """SELECT party_code AS party, cast(sum(kept) as bigint) AS kept, cast(count(*) - sum(kept) as bigint) AS broken, count(*) AS total,
    round_even(100 * sum(kept) / count(*), 0) AS keep_pct FROM promise_result GROUP BY 1""")
def _(b):
    return promises.keeping_by_party(promises.party_promise_results(b.promise, b.promise_vote_map, b.party_line, b.vote_head))


@query("promise_breakers", "SELECT person_id, full_name, party_current, against, eval, rate FROM breaker")
def _(b):
    return b.breakers


@query("survey_party_stance", "SELECT election, party, party_code, statement_id, mean, n, agree_pct FROM survey_stance")
def _(b):
    return b.survey_stance


# --- retrieval ----------------------------------------------------------------
BM25_SQL = """WITH st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM search_tokens),
    tf AS (SELECT id, term, len(list_filter(range(1, len(toks) - len(term) + 2), lambda i: toks[i:i + len(term) - 1] = term)) AS tf, len(toks) AS dl FROM search_tokens, (VALUES {terms}) q(term)),
    df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1),
    scored AS (SELECT id, count(*) FILTER (tf > 0) AS held,
      sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
        * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) AS score
      FROM tf JOIN df USING (term) CROSS JOIN st GROUP BY id HAVING count(*) FILTER (tf > 0) {need})
    """


@query("search_bm25", BM25_SQL.format(terms="(['widget']), (['mentre']), (['thon']), (['el']), (['of', 'the'])", need=">= 1") + """
    SELECT s.id, first_name || ' ' || last_name AS who, party, started_at, legislative_item, substr(text, 1, 700) AS text, person_id, round(score, 6) AS score
    FROM scored JOIN speech s USING (id) ORDER BY round(score, 9) DESC, id LIMIT 8""")
def _(b):
    return search.retrieve(b.search_index, b.speech, 'widget "mentré" thon el x of-the', k=8)


@query("search_index_rebuild", "SELECT term, doc_id, tf, doc_length FROM postings")
def _(b):
    return b.search_index.postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), "doc_length")


@query("search_index_incremental", "SELECT term, doc_id, tf, doc_length FROM postings")
def _(b):
    """Loads by session year, one segment each and merged as they come; the first year's speeches are loaded again at the end."""
    years = b.speech.withColumn("year", F.substring("started_at", 1, 4))
    index = None
    for (year,) in years.select("year").distinct().orderBy("year").collect():  # a row per year
        load = years.where(F.col("year") == year)
        index = index.add(load) if index else postings.build(load, "id", "text", fresh_path(b.spark, "yearly-index"))
    if index is None:
        index = postings.build(b.speech, "id", "text", fresh_path(b.spark, "yearly-index"))
    index = index.replace(years.where(F.col("year") == F.lit("1995")))
    return index.postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), "doc_length")


@query("search_term_statistics", "SELECT term, count(*) AS n_docs, cast(sum(tf) as bigint) AS n_hits FROM postings GROUP BY 1")
def _(b):
    return b.search_index.term_statistics()


SNIP_WORD = bind._SEARCH_TOK.replace("text", "x")
SNIP_SQL = f"""SELECT id, CASE WHEN st > 1 THEN '…' ELSE '' END || array_to_string(list_transform(w[st:st + 11], lambda x: CASE WHEN list_has_any({SNIP_WORD}, ['the', 'thon'])
      THEN '<mark>' || x || '</mark>' ELSE x END), ' ') || CASE WHEN st + 12 <= len(w) THEN '…' ELSE '' END AS snip
    FROM (SELECT id, w, greatest(1, least(list_position(list_transform(w, lambda x: list_has_any({SNIP_WORD}, ['the', 'thon'])), true), len(w) - 11)) AS st
    FROM (SELECT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM speech))"""


@query("search_all", BM25_SQL.format(terms="(['the']), (['thon'])", need="= 2") + f"""
    SELECT kind, id, label FROM (SELECT 'speech' AS kind, id, snip AS label FROM scored JOIN ({SNIP_SQL}) USING (id) ORDER BY round(score, 9) DESC, id LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'vote' AS kind, vote_id, title FROM vote WHERE title ILIKE '%the thon%' OR legislative_item ILIKE '%the thon%' OR item_title ILIKE '%the thon%' ORDER BY session_date DESC, vote_id LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'person' AS kind, person_id, full_name FROM person WHERE full_name ILIKE '%the thon%' ORDER BY full_name, person_id LIMIT 30)""")
def _(b):
    return search.search_all(b.person, b.vote_head, b.search_index, b.speech, "the thon")


@query("search_semantic", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
    h AS (SELECT vec_id, round(list_dot_product(cast(embedding as double[]), cast(e as double[])) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])))
      * sqrt(list_dot_product(cast(e as double[]), cast(e as double[])))), 9) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 30)
    SELECT s.id, s.person_id, first_name, last_name, party, started_at, legislative_item, substr(text, 1, 220) AS snip, round_even(score, 3) AS score,
      cast(pos as int) AS pos FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS pos FROM h) h JOIN speech s ON s.id = h.vec_id""")
def _(b):
    e = b.embedding
    hits = search.cosine_top_k(e, "vec_id", "embedding", e.where("vec_id = 0").select("embedding"), 30)
    ranked = hits.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id"))).alias("h")) \
        .select(F.posexplode("h")).selectExpr("pos", "col.vec_id AS vec_id", "-col.neg AS score")
    return search.by_id_order(b.speech, ranked, "vec_id").drop("ptk_id")


# --- coverage -----------------------------------------------------------------
def tables(b) -> dict[str, DataFrame]:
    return {"persons": b.person, "votes": b.vote_head, "vote_records": b.vote_record, "speeches": b.speech, "promises": b.promise}


@query("cov_stats", f"""SELECT 'persons' AS metric, 'yhteensä' AS dimension, cast(count(*) as varchar) AS value FROM person
    UNION ALL SELECT 'votes', 'yhteensä', cast(count(*) as varchar) FROM vote UNION ALL SELECT 'vote_records', 'yhteensä', cast(count(*) as varchar) FROM vote_record
    UNION ALL SELECT 'speeches', 'yhteensä', cast(count(*) as varchar) FROM speech UNION ALL SELECT 'promises', 'yhteensä', cast(count(*) as varchar) FROM promise
    UNION ALL SELECT 'votes', 'vuosi ' || vp_year, cast(count(*) as varchar) FROM vote GROUP BY vp_year
    UNION ALL SELECT 'speeches', 'vuosi ' || substr(started_at, 1, 4), cast(count(*) as varchar) FROM speech GROUP BY substr(started_at, 1, 4)
    UNION ALL SELECT 'aiheluokiteltu', 'äänestykset %', cast(round_even(100 * (SELECT count(DISTINCT vote_id) FROM vote_topic WHERE topic_id <> {bind.FALLBACK_ID}) / count(*), 1) as varchar) FROM vote
    UNION ALL SELECT 'aiheluokiteltu', 'puheet %', cast(round_even(100 * (SELECT count(DISTINCT speech_id) FROM speech_topic WHERE topic_id <> {bind.FALLBACK_ID}) / count(*), 1) as varchar) FROM speech
    UNION ALL SELECT 'puheet_henkilölinkitetty', '%', cast(round_even(100 * count(person_id) / count(*), 1) as varchar) FROM speech""")
def _(b):
    return coverage.coverage_stats(tables(b), b.speech_topic, b.vote_topic, bind.FALLBACK_ID)


@query("cov_report_tables", """SELECT section, label, cast(value as varchar) AS value FROM (SELECT 'core' AS section, 'persons' AS label, count(*) AS value FROM person UNION ALL SELECT 'core', 'votes', count(*) FROM vote
    UNION ALL SELECT 'core', 'vote_records', count(*) FROM vote_record UNION ALL SELECT 'core', 'speeches', count(*) FROM speech
    UNION ALL SELECT 'core', 'promises', count(*) FROM promise UNION ALL SELECT 'core', 'speeches_linked', count(person_id) FROM speech
    UNION ALL SELECT 'votes_per_year', cast(vp_year as varchar), count(*) FROM vote GROUP BY 2 UNION ALL SELECT 'speeches_per_year', substr(started_at, 1, 4), count(*) FROM speech GROUP BY 2
    UNION ALL SELECT 'persons_per_party', party_current, count(*) FROM person GROUP BY 2 UNION ALL SELECT 'confidence', confidence_level, count(*) FROM member_summary GROUP BY 2
      UNION ALL SELECT 'core', 'promise_mappings', count(*) FROM promise_vote_map)
    UNION ALL SELECT 'topic_coverage', dimension, value FROM (""" + ORACLES["cov_stats"] + """) WHERE metric = 'aiheluokiteltu'
    UNION ALL SELECT 'ingest', job, status || ' ' || n FROM ingest_state""")
def _(b):
    stats = coverage.coverage_stats(tables(b), b.speech_topic, b.vote_topic, bind.FALLBACK_ID)
    return coverage.report_tables(tables(b), b.person, b.member_summary, b.promise_vote_map, stats, b.ingest_state)


@query("cov_overview", """SELECT (SELECT count(*) FROM person) AS persons, (SELECT count(*) FROM vote) AS votes, (SELECT count(*) FROM vote_record) AS vote_records,
    (SELECT count(*) FROM speech) AS speeches, (SELECT count(*) FROM promise) AS promises,
    (SELECT string_agg(vp_year || ':' || n, ',' ORDER BY vp_year) FROM (SELECT vp_year, count(*) AS n FROM vote GROUP BY 1)) AS years_votes""")
def _(b):
    years = F.transform("years_votes", lambda y: F.concat_ws(":", y["vp_year"].cast("string"), y["n"].cast("string")))
    return coverage.overview(tables(b)).withColumn("years_votes", F.array_join(years, ","))


@query("cov_list", """SELECT metric, dimension, value FROM (SELECT 'votes' AS metric, 'vuosi ' || vp_year AS dimension, cast(count(*) as varchar) AS value FROM vote GROUP BY vp_year
    UNION ALL SELECT 'votes', 'yhteensä', cast(count(*) as varchar) FROM vote)""")
def _(b):
    stats = coverage.coverage_stats(tables(b), b.speech_topic, b.vote_topic, bind.FALLBACK_ID)
    return stats.where("metric = 'votes'").orderBy("metric", "dimension")


@query("dq_invariants", """SELECT 'duplicate_vote_record' AS "check", count(*) AS violations FROM (SELECT vote_id, person_id FROM vote_record GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'orphan_summary', count(*) FROM member_summary WHERE person_id NOT IN (SELECT person_id FROM person)
    UNION ALL SELECT 'value_outside_domain', count(*) FROM vote_record WHERE vote_value NOT IN ('Jaa', 'Ei', 'Tyhjää', 'Poissa')
    UNION ALL SELECT 'rate_mismatch', count(*) FROM member_summary WHERE n_votes_eligible > 0 AND abs(deviation_rate - n_deviations / n_votes_eligible) > 1e-9
    UNION ALL SELECT 'index_outside_range', count(*) FROM member_summary WHERE consistency_index NOT BETWEEN 0 AND 100
    UNION ALL SELECT 'mapped_to_procedural', count(*) FROM promise_vote_map WHERE vote_id IN (SELECT vote_id FROM vote WHERE is_procedural <> 0)
    UNION ALL SELECT 'record_without_vote', count(*) FROM vote_record WHERE vote_id NOT IN (SELECT vote_id FROM vote)""")
def _(b):
    return coverage.invariants(b.vote_head, b.vote_record, b.person, b.member_summary, b.promise_vote_map)


def _counted(name: str) -> str:
    """Rows of a batch table: those of its view, or of the query of that name."""
    sources = {"party_token": "party_tokens", "coalition_vote": "coalition"}
    if name == "style_count":
        return "(SELECT count(*) FROM style_hits) + (SELECT count(DISTINCT person_id) FROM speech)"
    if name in ("gov_winrate", "gov_lost", "political_map", "rhetoric_map", "coverage_stat"):
        return f"(SELECT count(*) FROM ({ORACLES['cov_stats' if name == 'coverage_stat' else name]}) q)"
    return f"(SELECT count(*) FROM {sources.get(name, name)})"


BATCH = ("vote_record vote topic topic_keyword speech_topic vote_topic party_line party_deviation member_summary member_topic position_change party_token party_words "
         "style_count word_usage word_hits power_effect coalition_vote gov_winrate gov_lost political_map rhetoric_map coverage_stat").split()


@query("run_all", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {_counted(t)} AS n_rows" for t in BATCH))
def _(b):
    """The whole batch written to the shared folder; the result lists the rows of each table."""
    from votemill.plans.batch import run_all

    path = fresh_path(b.spark, "analysis")
    done = run_all(
        dict(person=b.person, vote=b.vote, vote_record=b.vote_record, speech=b.speech, legislation=b.legislation,
             promise=b.promise, embedding=b.embedding),
        path, lexicon=bind.LEXICON, periods=bind.PERIODS, stopwords=bind.STOPWORDS, style=bind.STYLE,
        map_years=bind.YEARS, map_groups=MAP, min_party_total=1000, min_power_votes=10, min_map_votes=50, embedding_dim=64)
    return coverage.table_counts(done).withColumnRenamed("metric", "table").withColumnRenamed("value", "n_rows")
