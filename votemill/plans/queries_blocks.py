"""Building blocks: predicates, projections, joins, aggregates, windows, sorts, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from votemill import constants as C
from votemill.functions import scalars as S, text as X
from votemill.operators import corpus, maps, members, power, published, search, sketches, topics, vector_index
from votemill.operators import relational as R
from votemill.plans import bind
from votemill.plans.registry import query
from votemill.runtime import fresh_path, global_rank
from votemill.sources import members as member_source

HINTS = ("red", "small ring", "blue")


# --- predicates and projections ---------------------------------------------------
@query("pred_procedural", """SELECT p_partkey AS vote_id, cast(contains(t, 'red') OR contains(t, 'small ring') OR contains(t, 'blue') as int) AS is_procedural
    FROM (SELECT p_partkey, lower(concat_ws(' ', upper(p_name), p_brand, p_type)) AS t FROM part)""")
def _(b):
    return b.base("part").select(F.col("p_partkey").alias("vote_id"), S.is_procedural(
        F.upper("p_name"), F.col("p_brand"), F.col("p_type"), hints=HINTS).alias("is_procedural"))


@query("pred_bill_passage", f"SELECT vote_id, title, cast(title = '{bind.CLEAN_TITLE}' as int) AS is_passage FROM vote")
def _(b):
    return b.vote_head.select("vote_id", "title", S.is_bill_passage(F.col("title")).cast("int").alias("is_passage"))


@query("pred_clean_vote_like", """SELECT vote_id, title FROM vote WHERE lower(title) LIKE 'hyväksyminen / hylk%'
    OR (lower(title) LIKE 'mietintö /%' AND lower(title) LIKE '%hylk%')""")
def _(b):
    return b.vote_head.where(S.is_clean_vote(F.col("title"))).select("vote_id", "title")


@query("pred_reluctance", """SELECT id, CASE WHEN contains(lower(text), 'of the') THEN 'of the' WHEN contains(lower(text), 'de la') THEN 'de la'
    WHEN contains(lower(text), 'die der') THEN 'die der' WHEN contains(lower(text), 'los ') THEN 'los ' END AS marker FROM speech""")
def _(b):
    return b.speech.select("id", S.reluctance(F.col("text"), bind.MARKERS).alias("marker"))


@query("pred_active_overlap", """SELECT person_id FROM person WHERE person_id NOT IN (SELECT person_id FROM person_term) OR person_id IN (SELECT person_id FROM person_term
    WHERE coalesce(cast(substr(end_date, 1, 4) as int), 2999) >= 1996 AND coalesce(cast(substr(start_date, 1, 4) as int), 1900) <= 1996)""")
def _(b):
    return member_source.active_members(b.person_term, b.person, 1996, 1996).select("person_id")


@query("pred_substantive", """SELECT vote_id, person_id, cast(vote_value IN ('Jaa', 'Ei') as int) AS substantive, cast(vote_value IN ('Jaa', 'Ei', 'Tyhjää') as int) AS is_cast,
    cast(vote_value = 'Poissa' as int) AS absent FROM vote_record""")
def _(b):
    v = F.col("vote_value")
    return b.vote_record.select("vote_id", "person_id", S.is_substantive(v).cast("int").alias("substantive"),
                                S.is_cast(v).cast("int").alias("is_cast"), (v == C.ABSENT).cast("int").alias("absent"))


@query("pred_search_like", """SELECT * FROM (SELECT vote_id, session_date, title, legislative_item FROM vote WHERE title ILIKE '%WIDGET%' OR legislative_item ILIKE '%WIDGET%'
    OR item_title ILIKE '%WIDGET%' ORDER BY session_date DESC, vote_id LIMIT 30)""")
def _(b):
    return search.search_votes(b.vote_head, "WIDGET")


@query("search_speeches_like", """SELECT id, first_name, last_name, party, ptk_id, started_at, substr(text, 1, 160) AS snip FROM speech WHERE text ILIKE '%THE THE%' ORDER BY id LIMIT 30""")
def _(b):
    return search.search_speeches_like(b.speech, "THE THE")


@query("proj_preview", "SELECT id, substr(text, 1, 160) AS p160, substr(text, 1, 700) AS p700 FROM speech")
def _(b):
    return b.speech.select("id", S.preview(F.col("text"), 160).alias("p160"), S.preview(F.col("text"), 700).alias("p700"))


@query("proj_vote_text", "SELECT vote_id, text FROM vote_text")
def _(b):
    return topics.vote_texts(b.vote_head, b.legislation)


@query("proj_doc_url", f"SELECT id, '{S.DOC_BASE_URL}/Poytakirja/Sivut/' || replace(replace(ptk_id, ' ', '_'), '/', '+') || '.aspx' AS url FROM speech")
def _(b):
    return b.speech.select("id", S.document_url(F.col("ptk_id"), "Poytakirja").alias("url"))


# --- joins ----------------------------------------------------------------------
@query("join_inner_equi", "SELECT vote_id, person_id, vote_value, session_date, is_procedural FROM vote_record JOIN vote USING (vote_id)")
def _(b):
    return b.vote_record.select("vote_id", "person_id", "vote_value").join(b.vote_head.select("vote_id", "session_date", "is_procedural"), "vote_id")


@query("join_left_outer", "SELECT vote_id, legislative_item, l.title AS leg_title, l.url FROM vote LEFT JOIN legislation l ON eduskunta_tunnus = legislative_item")
def _(b):
    leg = b.legislation.select(F.col("eduskunta_tunnus").alias("legislative_item"), F.col("title").alias("leg_title"), "url")
    return b.vote_head.select("vote_id", "legislative_item").join(leg, "legislative_item", "left")


@query("join_semi", "SELECT id, person_id FROM speech WHERE legislative_item IN (SELECT legislative_item FROM vote WHERE is_procedural = 1)")
def _(b):
    return b.speech.join(b.vote_head.where("is_procedural = 1"), "legislative_item", "left_semi").select("id", "person_id")


@query("join_anti", "SELECT id, person_id FROM speech WHERE id NOT IN (SELECT speech_id FROM stance)")
def _(b):
    return b.speech.join(b.stance.select(F.col("speech_id").alias("id")), "id", "left_anti").select("id", "person_id")


@query("join_exists_flag", """SELECT vote_id, CASE WHEN EXISTS (SELECT 1 FROM speech s WHERE s.legislative_item = v.legislative_item AND s.id % 10 = 3) THEN 1 ELSE 0 END AS has_explainer FROM vote v""")
def _(b):
    known = b.explainer.select("legislative_item").distinct().withColumn("_e", F.lit(1))
    return b.vote_head.select("vote_id", "legislative_item").join(known, "legislative_item", "left") \
        .select("vote_id", F.coalesce("_e", F.lit(0)).alias("has_explainer"))


#: Characters of a bill's corpus in one row.
CORPUS_PART = 20_000


def neighbour_pairs(b):
    """Requested pairs: every member with the next two by id."""
    return b.person.select(F.col("person_id").alias("a"), F.explode(F.array(F.col("person_id") + 1, F.col("person_id") + 2)).alias("b"))


PAIR_SQL = """SELECT x.person_id AS a, y.person_id AS b, {cols} FROM vote_record x JOIN vote_record y ON x.vote_id = y.vote_id AND (y.person_id = x.person_id + 1 OR y.person_id = x.person_id + 2)
    WHERE x.vote_value IN ('Jaa', 'Ei') AND y.vote_value IN ('Jaa', 'Ei')"""


@query("join_self_pairs", PAIR_SQL.format(cols="x.vote_id AS vote_id, x.vote_value AS va, y.vote_value AS vb"))
def _(b):
    own = b.vote_record.where(S.is_substantive(F.col("vote_value")))
    va = own.select(F.col("person_id").alias("a"), "vote_id", F.col("vote_value").alias("va"))
    vb = own.select(F.col("person_id").alias("b"), "vote_id", F.col("vote_value").alias("vb"))
    return neighbour_pairs(b).join(va, "a").join(vb, ["b", "vote_id"])


@query("join_interval_pm30", """SELECT person_id, topic_id, session_date AS day, count(*) AS n_votes, max(near) AS near FROM pair_near JOIN vote USING (vote_id) GROUP BY 1, 2, 3""")
def _(b):
    return members.near_speech(b.topic_days).where("n_votes > 0").select(
        "person_id", "topic_id", F.col("day").cast("string").alias("day"), "n_votes", "near")


@query("join_period_range", """SELECT vote_id, session_date, coalesce((SELECT string_agg(g, ',' ORDER BY g) FROM period p WHERE p.s <= v.session_date AND v.session_date < p.e), '') AS coalition FROM vote v""")
def _(b):
    return b.vote_head.select("vote_id", "session_date", F.array_join(F.array_sort(power.coalition_at(F.col("session_date"), bind.PERIODS)), ",").alias("coalition"))


@query("join_lexicon_cross", """SELECT item_id AS id, topic_id, trim(p1 || ' ' || p2) AS keyword, count(*) AS hits FROM item_pos JOIN topic_keyword
    ON starts_with(t1, p1) AND (p2 = '' OR starts_with(coalesce(t2, ''), p2)) WHERE item_type = 'speech' GROUP BY 1, 2, 3""")
def _(b):
    """Text by keyword as one array expression per text instead of a product of rows."""
    line = b.speech.select("id", X.token_line(F.col("text")).alias("l"))
    cells = [F.struct(F.lit(i).alias("topic_id"), F.lit(k).alias("keyword"), X.prefix_count(F.col("l"), k).cast("long").alias("hits"))
             for i, _, _, kws in bind.LEXICON for k, _ in kws]
    return line.select("id", F.inline(F.array(*cells))).where("hits > 0")


@query("join_nested_loop_nearest", """WITH pt AS (SELECT person_id, party_current AS party, cast(coalesce(y, 0) as double) AS dim1, cast(coalesce(n, 0) as double) AS dim2 FROM person
      LEFT JOIN (SELECT person_id, count(*) FILTER (vote_value = 'Jaa') AS y, count(*) FILTER (vote_value = 'Ei') AS n FROM vote_record GROUP BY 1) USING (person_id)),
    ct AS (SELECT party, avg(dim1) AS cx, avg(dim2) AS cy FROM pt GROUP BY 1 HAVING count(*) >= 3)
    SELECT person_id, pt.party, dim1, dim2, arg_min(ct.party, round((dim1 - cx) * (dim1 - cx) + (dim2 - cy) * (dim2 - cy), 6)) AS nearest_party,
      round(max(CASE WHEN ct.party = pt.party THEN sqrt((dim1 - cx) * (dim1 - cx) + (dim2 - cy) * (dim2 - cy)) END), 6) AS dist_own FROM pt, ct GROUP BY 1, 2, 3, 4""")
def _(b):
    v = F.col("vote_value")
    n = b.vote_record.groupBy("person_id").agg(F.count_if(v == "Jaa").alias("y"), F.count_if(v == "Ei").alias("n"))
    pts = b.person.select("person_id", F.col("party_current").alias("party")).join(n, "person_id", "left").select(
        "person_id", "party", F.coalesce("y", F.lit(0)).cast("double").alias("dim1"), F.coalesce("n", F.lit(0)).cast("double").alias("dim2"))
    return maps.nearest_centroid(pts, maps.centroids(pts)).withColumn("dist_own", F.round("dist_own", 6))


# --- aggregates -------------------------------------------------------------------
@query("agg_group_count", "SELECT vp_year, vote_value, count(*) AS n FROM vote_record JOIN vote USING (vote_id) GROUP BY 1, 2 HAVING count(*) >= 10")
def _(b):
    return b.vote_record.join(b.vote_head.select("vote_id", "vp_year"), "vote_id").groupBy("vp_year", "vote_value") \
        .agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("agg_conditional", """SELECT person_id, count(*) FILTER (vote_value = 'Poissa') AS absent, round(100.0::double * count(*) FILTER (vote_value = 'Poissa') / count(*), 6) AS absent_pct
    FROM vote_record GROUP BY 1""")
def _(b):
    absent = F.count_if(F.col("vote_value") == C.ABSENT)
    return b.vote_record.groupBy("person_id").agg(absent.alias("absent"), F.round(100.0 * absent / F.count(F.lit(1)), 6).alias("absent_pct"))


@query("agg_distinct", "SELECT party, count(DISTINCT person_id) AS persons, count(DISTINCT vote_id) AS votes FROM vote_record GROUP BY 1")
def _(b):
    return b.vote_record.groupBy("party").agg(F.countDistinct("person_id").alias("persons"), F.countDistinct("vote_id").alias("votes"))


@query("agg_distinct_sketches", """SELECT party, count(*) AS n_rows, count(DISTINCT person_id) AS persons, count(DISTINCT vote_id) AS votes, true AS persons_close, true AS votes_close
    FROM vote_record JOIN vote USING (vote_id) GROUP BY 1""")
def _(b):
    """Sketches per year, of which even years are refreshed after a load; estimates are held against the exact counts (4 standard errors)."""
    path, values = fresh_path(b.spark, "sketches"), ["person_id", "vote_id"]
    rec = b.vote_record.select("party", *values).join(b.vote_head.select("vote_id", "vp_year"), "vote_id")
    sketches.refresh(rec.where("vp_year % 2 = 1 or person_id % 3 = 0"), path, "vp_year", ["party"], values)
    sketches.refresh(rec.where("vp_year % 2 = 0"), path, "vp_year", ["party"], values)
    estimate = sketches.distinct_counts(b.spark, path, ["party"], values)
    exact = rec.groupBy("party").agg(F.countDistinct("person_id").alias("persons"), F.countDistinct("vote_id").alias("votes"))

    def close(estimated, counted):
        return F.abs(F.col(estimated) - F.col(counted)) <= F.ceil(4 * sketches.relative_error() * F.col(counted))

    met = estimate.withColumnRenamed("party", "_party").join(exact, F.col("_party").eqNullSafe(F.col("party")))
    return met.select("party", "n_rows", "persons", "votes", close("person_id", "persons").alias("persons_close"), close("vote_id", "votes").alias("votes_close"))


@query("agg_avg_null_skip", """SELECT party_current, count(*) AS n, round(avg(consistency_index), 6) AS avg_idx, round(avg(deviation_rate), 6) AS avg_dev, max(full_name) AS last_name
    FROM person LEFT JOIN member_summary USING (person_id) GROUP BY 1""")
def _(b):
    return b.person.join(b.member_summary, "person_id", "left").groupBy("party_current").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("consistency_index"), 6).alias("avg_idx"),
        F.round(F.avg("deviation_rate"), 6).alias("avg_dev"), F.max("full_name").alias("last_name"))


@query("agg_majority", "SELECT line, party, count(*) AS n FROM party_line GROUP BY 1, 2")
def _(b):
    return b.party_line.groupBy("line", "party").agg(F.count(F.lit(1)).alias("n"))


@query("agg_vector_mean", """SELECT person_id, cast(i - 1 as int) AS pos, round(avg(cast(embedding[i] as double)), 6) AS value, count(*) AS n FROM (
    SELECT vec_id % (SELECT count(*) // 20 FROM embeddings) AS person_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2""")
def _(b):
    return maps.mean_embedding(b.embedding, 64).select("person_id", "n", F.posexplode("mean")) \
        .select("person_id", "pos", F.round("col", 6).alias("value"), "n")


@query("agg_pivot_matrix", """SELECT party, """ + ", ".join(
    f"count(*) FILTER (vp_year = {y}) AS y{y}" for y in bind.YEARS) + " FROM vote_record JOIN vote USING (vote_id) GROUP BY party")
def _(b):
    m = b.vote_record.join(b.vote_head.select("vote_id", "vp_year"), "vote_id").groupBy("party").pivot("vp_year", list(bind.YEARS)).agg(F.count(F.lit(1)))
    return m.na.fill(0).select("party", *[F.col(f"`{y}`").alias(f"y{y}") for y in bind.YEARS])


@query("agg_concat_corpus", f"""WITH c AS (SELECT legislative_item, string_agg(text, ' ' ORDER BY id) AS t FROM speech WHERE text IS NOT NULL GROUP BY 1)
    SELECT legislative_item, part, substr(t, part * {CORPUS_PART} + 1, {CORPUS_PART}) AS text FROM (SELECT *, unnest(range(0, (length(t) + {CORPUS_PART - 1}) // {CORPUS_PART})) AS part FROM c)""")
def _(b):
    """The joined corpus of every bill, in parts of a bounded number of characters that follow each other."""
    return corpus.joined(b.speech, "legislative_item", ["id"], "text", CORPUS_PART)


@query("win_percentile_rating", """WITH v AS (SELECT person_id, 'absent' AS metric, cast(count(*) FILTER (vote_value = 'Poissa') as double) AS value FROM vote_record GROUP BY 1
      UNION ALL SELECT person_id, 'yes', cast(nullif(count(*) FILTER (vote_value = 'Jaa'), 0) as double) FROM vote_record GROUP BY 1),
    r AS (SELECT person_id, metric, cast(CASE WHEN count(*) OVER (PARTITION BY metric) > 1 THEN round_even(1 + 98 * (row_number() OVER (PARTITION BY metric ORDER BY value, person_id) - 1)
      / (count(*) OVER (PARTITION BY metric) - 1), 0) ELSE 50 END as int) AS rating FROM v WHERE value IS NOT NULL)
    SELECT person_id, max(rating) FILTER (metric = 'absent') AS absent, max(rating) FILTER (metric = 'yes') AS yes FROM vote_record LEFT JOIN r USING (person_id) GROUP BY 1""")
def _(b):
    v = F.col("vote_value")
    counts = b.vote_record.groupBy("person_id").agg(
        F.count_if(v == C.ABSENT).alias("absent"), F.nullif(F.count_if(v == C.YES), F.lit(0)).alias("yes"))
    return R.percentile_ratings(counts, "person_id", ["absent", "yes"])


@query("win_topn_per_group", """SELECT legislative_item, id, cast(rn as int) AS rank FROM (SELECT legislative_item, id, row_number() OVER (PARTITION BY legislative_item ORDER BY length(text) DESC, id) AS rn FROM speech)
    WHERE rn <= 8""")
def _(b):
    s = b.speech.select("legislative_item", "id", F.length("text").alias("len"))
    return R.top_n(s, ["legislative_item"], [F.desc("len"), F.asc("id")], 8).drop("len")


@query("win_lag_change", "SELECT person_id, item_base, count(*) AS n_changes, min(gap_days) AS min_gap FROM position_change GROUP BY 1, 2")
def _(b):
    return b.position_change.groupBy("person_id", "item_base").agg(F.count(F.lit(1)).alias("n_changes"), F.min("gap_days").alias("min_gap"))


@query("win_dedupe_first", """SELECT person_id, party, vote_id, vote_value, n_rows FROM (SELECT person_id, party, vote_id, vote_value, count(*) OVER w AS n_rows,
    row_number() OVER (w ORDER BY CASE vote_value WHEN 'Ei' THEN 0 WHEN 'Jaa' THEN 1 ELSE 2 END, vote_id DESC) AS rn FROM vote_record WINDOW w AS (PARTITION BY person_id, party)) WHERE rn = 1""")
def _(b):
    v = F.col("vote_value")
    order = [F.when(v == "Ei", 0).when(v == "Jaa", 1).otherwise(2), -F.col("vote_id")]
    return R.best_per_key(b.vote_record.select("person_id", "party", "vote_id", "vote_value"), ["person_id", "party"], order, "n_rows")


@query("win_share_of_total", """SELECT vp_year, party, n, round_even(100 * n / sum(n) OVER (PARTITION BY vp_year), 1) AS share FROM (
    SELECT vp_year, party, count(*) AS n FROM vote_record JOIN vote USING (vote_id) GROUP BY 1, 2)""")
def _(b):
    n = b.vote_record.join(b.vote_head.select("vote_id", "vp_year"), "vote_id").groupBy("vp_year", "party").agg(F.count(F.lit(1)).alias("n"))
    return R.share_of_total(n, "vp_year", "n", "share")


@query("win_max_normalise", """SELECT person_id, topic_id, round(n_votes / greatest(max(n_votes) OVER (PARTITION BY person_id), 1), 6) AS scaled FROM member_topic""")
def _(b):
    top = F.greatest(F.max("n_votes").over(W.partitionBy("person_id")), F.lit(1))
    return b.member_topic.select("person_id", "topic_id", F.round(F.col("n_votes") / top, 6).alias("scaled"))


# --- sorts, limits, samples -----------------------------------------------------------
@query("sort_nulls_last", """SELECT * FROM (SELECT person_id, full_name, round(deviation_rate, 6) AS deviation_rate, cast(row_number() OVER (ORDER BY deviation_rate IS NULL, deviation_rate DESC, full_name, person_id) as int) AS pos
    FROM person JOIN member_summary USING (person_id))""")
def _(b):
    d = published.member_directory(b.person, b.member_summary, sort="poikkeama", descending=True)
    order = F.struct(F.col("deviation_rate").isNull().alias("last"), (-F.col("deviation_rate")).alias("falling"), "full_name")
    ranked = global_rank(d.select("person_id", "full_name", "deviation_rate", order.alias("key"), F.lit(0).alias("all")), "all", "key", "person_id")
    return ranked.select("person_id", "full_name", F.round("deviation_rate", 6).alias("deviation_rate"), (F.col("rank0") + 1).cast("int").alias("pos"))


@query("topk_limit", "SELECT id, word_count FROM speech ORDER BY word_count DESC, id LIMIT 25")
def _(b):
    return b.speech.select("id", "word_count").orderBy(F.desc("word_count"), "id").limit(25)


@query("topk_vector", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
    SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_dot_product(cast(embedding as double[]), cast(e as double[])) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])))
      * sqrt(list_dot_product(cast(e as double[]), cast(e as double[])))) AS score FROM embeddings, q) ORDER BY round(score, 9) DESC, vec_id LIMIT 30""")
def _(b):
    e = b.base("embeddings")
    return search.cosine_top_k(e, "vec_id", "embedding", e.where("vec_id = 7").select("embedding"), 30).withColumn("score", F.round("score", 6))


@query("topk_vector_index")
def _(b):
    """The approximate form: every 50th vector against written inverted lists, whose cells to look under are measured at the build."""
    e = b.base("embeddings")
    index = vector_index.build(e, "vec_id", "embedding", fresh_path(b.spark, "vectors"))
    found = index.nearest_each(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 30)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("order_by_id_list", """WITH h AS (SELECT id, row_number() OVER (ORDER BY word_count DESC, id) - 1 AS pos, 1.0::double / word_count AS score FROM speech ORDER BY word_count DESC, id LIMIT 20)
    SELECT cast(pos as int) AS pos, s.id, person_id, first_name, last_name, party, ptk_id, started_at, legislative_item, substr(text, 1, 220) AS snip, round_even(score, 3) AS score FROM h JOIN speech s USING (id)""")
def _(b):
    top = b.speech.select("id", "word_count").orderBy(F.desc("word_count"), "id").limit(20)
    ids = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("word_count")).alias("neg"), "id"))).alias("h"))
    hits = ids.select(F.posexplode("h")).select("pos", F.col("col.id").alias("hit"), (1.0 / -F.col("col.neg")).alias("score"))
    return search.by_id_order(b.speech, hits, "hit")


@query("sample_random_k", "SELECT person_id FROM person ORDER BY md5(person_id || ':7'), person_id LIMIT 8")
def _(b):
    return published.seeded_sample(b.person.select("person_id"), "person_id", 8, "7")


@query("sort_case_priority", """SELECT person_id, legislative_item, vote_id, alignment FROM words_votes ORDER BY CASE alignment WHEN 'ristiriita' THEN 0 WHEN 'vastentahtoinen' THEN 1 WHEN 'linjassa' THEN 2
    WHEN 'konteksti' THEN 3 ELSE 4 END, confidence DESC, vote_id, person_id LIMIT 50""")
def _(b):
    return b.words_votes.orderBy(published._priority(), F.desc("confidence"), "vote_id", "person_id").limit(50) \
        .select("person_id", "legislative_item", "vote_id", "alignment")


# --- sets -------------------------------------------------------------------------
@query("set_union_distinct", "SELECT person_id FROM (SELECT person_id FROM vote_record UNION SELECT person_id FROM speech) WHERE person_id IN (SELECT person_id FROM person)")
def _(b):
    return members.active_persons(b.person, b.vote_record, b.speech)


@query("set_difference", "SELECT DISTINCT legislative_item FROM vote WHERE legislative_item NOT IN (SELECT legislative_item FROM stance)")
def _(b):
    return b.vote_head.select("legislative_item").distinct().join(b.stance.select("legislative_item"), "legislative_item", "left_anti")


# --- scalar functions ----------------------------------------------------------------
@query("fn_normalize_tokens", r"""SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(lower(nfc_normalize(text)), '<[^>]+>', ' ', 'g'), '[\p{L}\p{N}_-]+'), ' ') AS tokens FROM documents""")
def _(b):
    return b.base("documents").select("doc_id", F.array_join(X.tokens(X.nfc(F.col("text"))), " ").alias("tokens"))


@query("fn_prefix_count", """SELECT id, coalesce(th, 0) AS th, coalesce(of_the, 0) AS of_the FROM speech LEFT JOIN (SELECT item_id, cast(count(*) FILTER (starts_with(t1, 'th')) as int) AS th,
    cast(count(*) FILTER (starts_with(t1, 'e') AND starts_with(coalesce(t2, ''), 'e')) as int) AS of_the FROM item_pos WHERE item_type = 'speech' GROUP BY 1) ON item_id = id""")
def _(b):
    line = X.token_line(F.col("text"))
    return b.speech.select("id", X.prefix_count(line, "th").alias("th"), X.prefix_count(line, "e e").alias("of_the"))


@query("fn_phrase_count", """SELECT id, n FROM (SELECT id, 0 AS n FROM speech WHERE false) UNION ALL SELECT id, cast((SELECT count(*) FROM (SELECT toks[i] AS t1, toks[i + 1] AS t2 FROM (SELECT unnest(range(1, len(toks) + 1)) AS i)) p
    JOIN style_lexicon ON category = 'filler' AND t1 = w1 AND (w2 = '' OR t2 = w2)) as int) AS n FROM speech_tokens""")
def _(b):
    single, phrases = bind.STYLE["filler"]
    return b.speech.select("id", F.size(X.lexicon_hits(X.tokens(F.col("text")), single, phrases)).alias("n"))


@query("fn_topic_score", "SELECT item_id AS id, topic_id, round(score, 6) AS score FROM item_score WHERE item_type = 'speech'")
def _(b):
    rows = topics.with_candidates(b.speech, "id", "text", bind.LEXICON)
    return rows.select("id", F.inline(topics.topic_scores(bind.LEXICON))).where("score > 0").withColumn("score", F.round("score", 6))


@query("fn_word_count", "SELECT doc_id, cast(len(regexp_extract_all(text, '\\S+')) as int) AS words FROM documents")
def _(b):
    return b.base("documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("fn_fi_date", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dotted, strftime(o_orderdate, '%Y-%m-%d') AS iso, NULL::varchar AS bad FROM orders""")
def _(b):
    o = b.base("orders").select("o_orderkey", "o_orderdate")
    return o.select("o_orderkey", S.fi_date(F.date_format("o_orderdate", " d.M.yyyy ")).alias("dotted"),
                    S.fi_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("iso"),
                    S.fi_date(F.date_format("o_orderdate", "M/yyyy")).alias("bad"))


@query("fn_iso_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, NULL::varchar AS bad FROM events")
def _(b):
    e = b.base("events")
    return e.select("event_id", S.iso_day(F.date_format("ts", " yyyy-MM-dd'T'HH:mm:ss")).cast("string").alias("day"),
                    S.iso_day(F.date_format("ts", "dd.MM.yyyy")).cast("string").alias("bad"))


@query("fn_normalize_party", "SELECT DISTINCT p_brand, regexp_replace(lower(replace(p_brand, '#', '')), '[0-9]+$', '') AS code, NULL::varchar AS blank FROM part")
def _(b):
    p = b.base("part").select("p_brand").distinct()
    return p.select("p_brand", S.normalize_party(F.concat(F.lit(" "), F.upper(F.translate("p_brand", "#", "")), F.lit("  "))).alias("code"),
                    S.normalize_party(F.substring("p_brand", 7, 9)).alias("blank"))


@query("fn_vote_value", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'Jaa' WHEN 'A' THEN 'Tyhjää' ELSE l_returnflag END AS value FROM lineitem""")
def _(b):
    raw = F.when(F.col("l_returnflag") == "R", " Jaa ").when(F.col("l_returnflag") == "A", "Tyhjiä").otherwise(F.col("l_returnflag"))
    return b.base("lineitem").select("l_orderkey", "l_linenumber", S.vote_value(raw).alias("value"))


@query("fn_to_int", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS n FROM customer")
def _(b):
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("c_custkey"))).otherwise(F.concat(F.lit(" "), F.col("c_custkey")))
    return b.base("customer").select("c_custkey", S.to_int(text).alias("n"))


@query("fn_doc_type", "SELECT p_partkey, split_part(p_name, ' ', 1) AS doc_type FROM part")
def _(b):
    return b.base("part").select("p_partkey", S.doc_type(F.col("p_name")).alias("doc_type"))


@query("fn_party_code", f"SELECT c_custkey, code FROM customer LEFT JOIN (VALUES {bind._values(bind.SURVEY_CODES.items())}) m(name, code) ON name = lower(c_mktsegment)")
def _(b):
    return b.base("customer").select("c_custkey", S.party_code(F.concat(F.lit(" "), F.col("c_mktsegment")), bind.SURVEY_CODES).alias("code"))


@query("fn_fts_query", """SELECT doc_id, coalesce(nullif(array_to_string(list_transform(q, lambda x: '"' || x || '"'), ' '), ''), '""') AS all_terms,
    coalesce(nullif(array_to_string(list_transform(list_filter(q, lambda x: length(x) > 1), lambda x: '"' || x || '"'), ' OR '), ''), '""') AS any_terms FROM (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, '"', ' '), '\\s+'), lambda x: length(x) > 0) AS q FROM documents)""")
def _(b):
    d = b.base("documents")
    return d.select("doc_id", X.fts_query(F.col("text")).alias("all_terms"), X.fts_query(F.col("text"), 2, " OR ").alias("any_terms"))


@query("fn_snippet", r"""SELECT id, CASE WHEN f = 0 THEN NULL ELSE CASE WHEN st > 1 THEN '…' ELSE '' END || array_to_string(list_transform(w[st:st + 11], lambda x: CASE WHEN
      list_has_any(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'), ['thon', 'widget', 'que']) THEN '<mark>' || x || '</mark>' ELSE x END), ' ') || CASE WHEN st + 12 <= len(w) THEN '…' ELSE '' END END AS snip
    FROM (SELECT id, w, f, greatest(1, least(f, len(w) - 11)) AS st FROM (SELECT id, w, coalesce(list_position(list_transform(w, lambda x:
      list_has_any(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'), ['thon', 'widget', 'que'])), true), 0) AS f
    FROM (SELECT id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM speech)))""")
def _(b):
    terms = F.array(*[F.lit(t) for t in ("thon", "widget", "que")])
    return b.speech.select("id", X.snippet(F.col("text"), terms).alias("snip"))


@query("fn_label_speaker", "SELECT id, first_name || ' ' || last_name || ' (' || party || ')' AS label FROM speech")
def _(b):
    return b.speech.select("id", S.speaker_label(F.col("first_name"), F.col("last_name"), F.col("party")).alias("label"))


@query("fn_card_flair", """SELECT person_id, CASE WHEN person_id % 10 = 0 OR is_minister = 1 THEN 'legendaarinen' WHEN coalesce(ns, 0) >= 400 OR y <= 2011 THEN 'harvinainen' ELSE 'perus' END AS rarity,
    concat_ws(',', CASE WHEN is_minister = 1 THEN 'Ministeri' END, CASE WHEN y <= 2011 THEN 'Konkari' END, CASE WHEN pct < 26 - 18 THEN 'Ahkera äänestäjä' END) AS traits FROM (
    SELECT person_id, is_minister, cast(substr(active_from, 1, 4) as int) AS y, 100.0::double * n_absent / n_votes_total / 4 AS pct, ns FROM person LEFT JOIN member_counts USING (person_id)
    LEFT JOIN (SELECT person_id, count(*) AS ns FROM speech GROUP BY 1) USING (person_id))""")
def _(b):
    n = b.vote_record.groupBy("person_id").agg((100.0 * F.count_if(F.col("vote_value") == C.ABSENT) / F.count(F.lit(1)) / 4).alias("pct"))
    year = F.substring("active_from", 1, 4).cast("int")
    badges = (F.col("person_id") % 10 == 0).cast("int")
    talks = b.speech.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_speeches"))
    return b.person.join(n, "person_id", "left").join(talks, "person_id", "left").select(
        "person_id", S.card_rarity(badges, F.col("is_minister"), F.col("n_speeches"), year).alias("rarity"),
        F.array_join(S.card_traits(F.col("is_minister"), year, F.col("pct")), ",").alias("traits"))


@query("fn_json_parse", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 5 <> 0 THEN cast(json_extract(props, '$.k') as bigint) END AS k FROM events""")
def _(b):
    text = F.when(F.col("event_id") % 5 == 0, F.col("props").substr(1, 3)).otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]")))
    e = b.base("events").select("event_id", S.json_list(text, "struct<k:bigint>").alias("j"))
    return e.select("event_id", F.size("j").alias("n"), F.get("j", F.lit(0))["k"].alias("k"))


@query("fn_commons_url", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://commons.wikimedia.org/wiki/File:P' || page_id || '.jpg' ELSE 'https://commons.wikimedia.org/' END AS file_url FROM pages""")
def _(b):
    thumb = F.concat(F.when(F.col("page_id") % 2 == 0, "https://upload.example/commons/thumb/a/ab/P").otherwise("https://upload.example/other/P"),
                     F.col("page_id"), F.lit(".jpg/320px-P.jpg"))
    return b.base("pages").select("page_id", S.file_page_url(thumb).alias("file_url"))


@query("fn_round_modes", """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half_even, round(l_quantity / 2, 0) AS half_away FROM lineitem""")
def _(b):
    half = F.col("l_quantity") / 2
    return b.base("lineitem").select("l_orderkey", "l_linenumber", S.round_even(half).alias("half_even"), F.round(half, 0).alias("half_away"))
