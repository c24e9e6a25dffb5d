"""Sources, loaders, sinks and streams, run on files that Spark first derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from votemill.functions import scalars as S
from votemill.operators import search, stance
from votemill.operators import relational as R
from votemill.plans import bind
from votemill.plans.registry import query
from votemill.runtime import fresh_path
from votemill.sources import loads, members, pages, sinks, votes, xml_rows
from votemill.sources.keyed import KeyedTable
from votemill.streaming import ingest


def landed_json(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.json(path)
    return path


# --- API pages --------------------------------------------------------------------
def page_file(b) -> str:
    """Line items as positional pages of about a hundred rows; odd pages order the columns differently."""
    li = b.base("lineitem").select(
        (F.col("l_orderkey") % 1000003).alias("o"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        F.expr("cast(l_orderkey div 25 as int)").alias("page"))
    text = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")]
    odd = F.col("page") % 2 == 1
    row = F.when(odd, F.array(*reversed(text))).otherwise(F.array(*text))
    names = ["OrderId", "Line", "VoteId", "PersonId", "Value"]
    cols = F.when(odd, F.array(*[F.lit(n) for n in reversed(names)])).otherwise(F.array(*[F.lit(n) for n in names]))
    page = (li.withColumn("row", row).groupBy("page").agg(F.collect_list("row").alias("rowData"))
            .select("page", cols.alias("columnNames"), "rowData", F.lit(True).alias("hasMore")))
    return landed_json(page, "pages")


@query("src_paged_json", "SELECT l_orderkey, l_linenumber, l_partkey AS vote_id, l_suppkey AS person_id, l_returnflag AS value, NULL::varchar AS absent FROM lineitem")
def _(b):
    rows = pages.named_rows(pages.read_pages(b.spark, page_file(b)), {
        "OrderId": "o", "Line": "l", "VoteId": "v", "PersonId": "p", "Value": "value", "Nothing": "absent"})
    return rows.select(S.to_int(F.col("o")).alias("l_orderkey"), S.to_int(F.col("l"), "int").alias("l_linenumber"),
                       S.to_int(F.col("v")).alias("vote_id"), S.to_int(F.col("p")).alias("person_id"), "value", "absent")


@query("src_filter_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def _(b):
    return pages.filter_rows(b.base("orders"), "o_orderpriority", "5-LOW").select("o_orderkey", "o_custkey")


# --- votes ------------------------------------------------------------------------
@query("src_vote_headers", """SELECT vote_id, vp_year, session_date, title, item_title, legislative_item, treatment_stage, result_yes, result_no,
    cast(contains(lower(title || ' ' || item_title), 'red') as int) AS is_procedural,
    'i/' || vote_id AS legislative_item_url, 'm/' || vote_id AS minutes_url, CASE WHEN vote_id % 3 <> 0 THEN 'u/' || vote_id END AS url FROM vote WHERE vote_id % 17 <> 0""")
def _(b):
    v = b.vote
    text = {c: F.col(c).cast("string") for c in ("vote_id", "vp_year", "result_yes", "result_no", "result_empty", "result_absent", "result_total")}
    rows = v.select(
        *[x.alias(c) for c, x in text.items()], F.lit(None).cast("string").alias("session_number"),
        "session_date", "title", "extra_title", "main_item_title", "item_title", "treatment_title", "treatment_stage", "legislative_item",
        F.lit(None).cast("string").alias("main_title"),
        F.concat(F.lit("i/"), "vote_id").alias("legislative_item_url"), F.concat(F.lit("m/"), "vote_id").alias("minutes_url"),
        F.when(F.col("vote_id") % 3 != 0, F.concat(F.lit("u/"), "vote_id")).alias("url"),
        F.when(F.col("vote_id") % 17 == 0, "1").when(F.col("vote_id") % 2 == 0, "0").alias("annulled"),
        F.explode(F.array(F.lit("1"), F.lit("2"))).alias("language"), F.lit(1).alias("page"), F.lit(1).alias("place"))
    again = rows.withColumn("title", F.lit("red later copy")).withColumn("page", F.lit(2))
    return votes.vote_headers(rows.unionByName(again), hints=("red",)).select(
        "vote_id", "vp_year", "session_date", "title", "item_title", "legislative_item", "treatment_stage",
        F.col("result_yes").cast("long").alias("result_yes"), F.col("result_no").cast("long").alias("result_no"), "is_procedural",
        "legislative_item_url", "minutes_url", "url")


@query("src_vote_records", "SELECT vote_id, person_id, first_name, last_name, lower(party) AS party, vote_value FROM vote_record")
def _(b):
    who = b.person.select("person_id", F.concat(F.lit(" "), "first_name").alias("first_name"), "last_name",
                          F.concat(F.col("party_current"), F.lit("  ")).alias("party"))
    rows = b.raw_record.join(who, "person_id").withColumn("vote_id", F.col("vote_id").cast("string")) \
        .withColumn("person_id", F.col("person_id").cast("string"))
    return votes.vote_records(rows)


# --- XML ------------------------------------------------------------------------------
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]"


def escaped(text: Column) -> Column:
    clean = F.regexp_replace(text, CONTROL, "")
    return F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tag(name: str, body: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attrs}>"), F.coalesce(body, F.lit("")), F.lit(f"</{name}>"))


def broken_where(cond: Column, xml: Column) -> Column:
    return F.when(cond, F.substring(xml, 1, 60)).otherwise(xml)


NS = ('xmlns:m="urn:meta" xmlns:v="urn:elements" xmlns:k="urn:blocks" xmlns:s="urn:content"')


def minutes_documents(b) -> DataFrame:
    """One minutes document per text: two paragraphs, a chair interjection, an empty second speech."""
    s = b.speech
    para = tag("s:KappaleKooste", escaped(F.col("text")))
    chair = "<k:PuheenjohtajaRepliikki><s:KappaleKooste>chair</s:KappaleKooste></k:PuheenjohtajaRepliikki>"
    key = F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(' m:muuTunnus="s'), F.col("id"), F.lit('"')))
    speech = F.concat(
        F.lit('<k:PuheenvuoroToimenpide v:puheenvuoroLuokitusKoodi="T" v:puheenvuoroJNro="'), F.col("id"),
        F.lit('" v:puheenvuoroAloitusHetki="'), F.col("started_at"), F.lit('"><k:Toimija><k:Henkilo m:muuTunnus="'),
        F.when(F.col("id") % 4 == 0, F.lit("x")).otherwise(F.col("person_id").cast("string")),
        F.lit('"/></k:Toimija><k:PuheenvuoroOsa'), key, F.lit("><k:KohtaSisalto>"), para, F.lit(chair),
        tag("s:KappaleKooste", F.lit(" second ")), F.lit("</k:KohtaSisalto></k:PuheenvuoroOsa></k:PuheenvuoroToimenpide>"),
        F.lit("<k:PuheenvuoroToimenpide><k:PuheenvuoroOsa><s:KappaleKooste> </s:KappaleKooste></k:PuheenvuoroOsa></k:PuheenvuoroToimenpide>"))
    xml = F.concat(F.lit(f"<Siirto {NS}><Poytakirja><Asiakohta eduskuntaTunnus=\""), F.col("legislative_item"), F.lit('"><Kohta>'),
                   speech, F.lit("</Kohta></Asiakohta></Poytakirja></Siirto>"))
    return s.select(F.concat(F.lit("PTK "), "id", F.lit("/2020 vp")).alias("ptk_id"), F.concat(F.lit("2020/"), "id").alias("session_key"),
                    broken_where(F.col("id") % 50 == 0, xml).alias("xml"))


# white space at the ends is trimmed by both sides the same way before comparing
ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


@query("src_minutes_xml", """SELECT CASE WHEN id % 3 = 0 THEN 'PTK ' || id || '/2020 vp#' || id ELSE 's' || id END AS external_key, CASE WHEN id % 4 <> 0 THEN person_id END AS person_id,
    'T' AS speech_type, started_at, legislative_item, '2020/' || id AS session_key, 'PTK ' || id || '/2020 vp' AS ptk_id,
    cast(len(regexp_extract_all(text, '\\S+')) + 1 as int) AS word_count, trim(regexp_replace(text, '\\s+', ' ', 'g') || ' second') AS text FROM speech WHERE id % 50 <> 0""")
def _(b):
    # the whole parsed text is compared, white space levelled on both sides
    parsed = xml_rows.minutes_speeches(minutes_documents(b))
    return parsed.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


def member_documents(b) -> DataFrame:
    """A biography per person: terms of the person, an earlier group, a cabinet post for ministers."""
    terms = b.person_term.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(
        F.lit("<Edustajatoimi>"), tag("AlkuPvm", F.date_format("start_date", "d.M.yyyy")),
        tag("LoppuPvm", F.coalesce(F.date_format("end_date", "dd.MM.yyyy"), F.lit(""))), F.lit("</Edustajatoimi>")))), "").alias("terms"))
    p = b.person.join(terms, "person_id", "left")
    pid, party = F.col("person_id"), F.col("party_current")
    now = F.when(pid % 5 != 0, F.concat(F.lit("<NykyinenEduskuntaryhma>"), tag("Nimi", party), tag("Tunnus", F.concat(party, F.lit("01"))),
                                        tag("AlkuPvm", F.lit("24.04.1999")), F.lit("</NykyinenEduskuntaryhma>"))).otherwise(F.lit(""))
    past = F.lit("<Eduskuntaryhma><Nimi>Old group</Nimi><Tunnus>old02</Tunnus><Jasenyys><AlkuPvm>1.3.1995</AlkuPvm><LoppuPvm>1.5.1997</LoppuPvm></Jasenyys>"
                 "<Jasenyys><AlkuPvm>1.3.1991</AlkuPvm><LoppuPvm>1.3.1993</LoppuPvm></Jasenyys></Eduskuntaryhma>")
    area = F.when(pid % 3 == 0, tag("VaaliPiiri", tag("Nimi", F.col("electoral_district")))) \
        .otherwise(F.concat(F.lit("<NykyinenVaalipiiri>"), tag("Nimi", F.col("electoral_district")), F.lit("</NykyinenVaalipiiri>")))
    cabinet = F.when(F.col("is_minister") == 1, F.lit("<ValtioneuvostonJasenyydet><Jasenyys><Ministeriys>ministeri</Ministeriys><Hallitus>h</Hallitus>"
                                                     "<AlkuPvm>10.06.2000</AlkuPvm></Jasenyys><Jasenyys><AlkuPvm>1.1.1990</AlkuPvm></Jasenyys></ValtioneuvostonJasenyydet>")).otherwise(F.lit(""))
    xml = F.concat(F.lit("<Henkilo>"), tag("Ammatti", F.lit("opettaja")), tag("SyntymaPvm", F.substring("active_from", 1, 4)), area,
                   F.lit("<Edustajatoimet>"), F.coalesce("terms", F.lit("")), F.lit("</Edustajatoimet>"), now, past, cabinet, F.lit("</Henkilo>"))
    return p.select("person_id", broken_where(pid % 13 == 12, xml).alias("xml"))


@query("src_members_xml", """SELECT p.person_id, CASE WHEN ok THEN substr(active_from, 1, 4) END AS birth_year, CASE WHEN ok THEN 'opettaja' END AS profession,
    CASE WHEN ok THEN electoral_district END AS electoral_district, CASE WHEN NOT ok THEN NULL WHEN p.person_id % 5 <> 0 THEN lower(party_current) ELSE 'old' END AS party_current,
    CASE WHEN NOT ok THEN NULL WHEN p.person_id % 5 <> 0 THEN party_current ELSE 'Old group' END AS party_current_name,
    CASE WHEN ok THEN cast(coalesce(n, 0) as int) END AS n_terms, CASE WHEN ok THEN first END AS first_term,
    CASE WHEN ok THEN CASE WHEN p.person_id % 5 <> 0 THEN 3 ELSE 2 END END AS n_groups, CASE WHEN ok THEN is_minister END AS n_roles
    FROM (SELECT *, person_id % 13 <> 12 AS ok FROM person) p LEFT JOIN (SELECT person_id, count(*) AS n, min(start_date) AS first FROM person_term GROUP BY 1) t ON t.person_id = p.person_id""")
def _(b):
    prof = xml_rows.member_profiles(member_documents(b))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return prof.select("person_id", "birth_year", "profession", "electoral_district", "party_current", "party_current_name",
                       size("terms").alias("n_terms"), F.array_min(F.transform("terms", lambda t: t["start"])).alias("first_term"),
                       size("parties").alias("n_groups"), size("minister_roles").alias("n_roles"))


@query("src_members_load", """SELECT p.person_id, first_name, last_name, first_name || ' ' || last_name AS full_name, is_minister, active_from, active_to FROM (
      SELECT person_id, first_name, last_name, CASE WHEN is_minister = 1 AND person_id % 13 <> 12 THEN 1 WHEN person_id % 7 = 0 THEN 1 ELSE 0 END AS is_minister FROM person) p
    LEFT JOIN (SELECT person_id, min(start_date) AS active_from, CASE WHEN bool_or(end_date IS NULL) THEN NULL ELSE max(end_date) END AS active_to,
      bool_or(coalesce(cast(substr(end_date, 1, 4) as int), 2999) >= 2001 AND coalesce(cast(substr(start_date, 1, 4) as int), 1900) <= 2005) AS hit
      FROM person_term WHERE person_id % 13 <> 12 GROUP BY 1) t ON t.person_id = p.person_id WHERE coalesce(hit, true)""")
def _(b):
    rows = b.person.select("person_id", F.concat("first_name", F.lit(" ")).alias("firstname"), F.col("last_name").alias("lastname"),
                           F.when(F.col("person_id") % 7 == 0, "t").otherwise("f").alias("minister"))
    out = members.load_members(rows, xml_rows.member_profiles(member_documents(b)), start_year=2001, end_year=2005)
    return out.select("person_id", "first_name", "last_name", "full_name", "is_minister", "active_from", "active_to")


@query("src_speeches_store", """SELECT CASE WHEN id % 3 = 0 THEN 'PTK ' || id || '/2020 vp#' || id ELSE 's' || id END AS external_key, CASE WHEN id % 4 <> 0 THEN s.person_id END AS person_id, CASE WHEN id % 4 <> 0 THEN first_name END AS first_name,
    CASE WHEN id % 4 <> 0 THEN last_name END AS last_name, CASE WHEN id % 4 <> 0 THEN party END AS party, legislative_item,
    'https://www.eduskunta.fi/FI/vaski/Poytakirja/Sivut/PTK_' || id || '+2020_vp.aspx' AS url FROM speech s WHERE id % 50 <> 0 AND id % 7 <> 0""")
def _(b):
    parsed = xml_rows.minutes_speeches(minutes_documents(b))
    known = b.speech.where("id % 7 = 0").selectExpr("CASE WHEN id % 3 = 0 THEN concat('PTK ', id, '/2020 vp#', id) ELSE external_key END AS external_key")
    return loads.store_speeches(parsed.unionByName(parsed), b.person, known) \
        .select("external_key", "person_id", "first_name", "last_name", "party", "legislative_item", "url")


@query("src_session_gap_stop", """SELECT year, number FROM (SELECT year, number, sum(stop) OVER (PARTITION BY year ORDER BY number) AS stopped FROM (
    SELECT year, number, CASE WHEN number - coalesce(lag(number) OVER (PARTITION BY year ORDER BY number), 0) - 1 >= 3 THEN 1 ELSE 0 END AS stop FROM (
    SELECT DISTINCT cast(1990 + o_custkey % 40 as int) AS year, cast(1 + o_orderkey * o_custkey % 997 as int) AS number FROM orders))) WHERE stopped = 0""")
def _(b):
    s = b.base("orders").selectExpr(
        "cast(1990 + o_custkey % 40 as int) AS year", "cast(1 + o_orderkey * o_custkey % 997 as int) AS number")
    return loads.sessions_until_gap(s, miss_stop=3)


def bill_documents(b) -> DataFrame:
    """Two versions of a document for every text on a bill: the title alone, and with a paragraph for each line of the text."""
    paras = F.concat(F.lit("<KappaleKooste>"), F.replace(escaped(F.col("text")), F.lit("\n"), F.lit("</KappaleKooste><KappaleKooste>")), F.lit("</KappaleKooste>"))
    head = tag("OtsikkoTeksti", F.concat(F.lit(" Bill "), F.col("legislative_item")))
    full = F.concat(F.lit("<Asiakirja><SisaltoKuvaus> </SisaltoKuvaus>"), head, F.lit("<KappaleKooste> </KappaleKooste>"), paras, F.lit("</Asiakirja>"))
    short = F.concat(F.lit("<Asiakirja>"), head, F.lit("</Asiakirja>"))
    broken = F.col("id") % 70 == 0
    return b.speech.select(F.col("legislative_item").alias("eduskunta_tunnus"),
                           F.explode(F.array(short, F.when(broken, F.concat(full, F.lit("<"))).otherwise(full))).alias("xml"))


@query("src_legislation", r"""WITH d AS (SELECT legislative_item, id, text, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</KappaleKooste><KappaleKooste>') || CASE WHEN id % 70 = 0 THEN '<' ELSE '' END AS xml FROM speech),
    best AS (SELECT legislative_item, arg_max(id, (length(xml), xml)) AS id, arg_max(text, (length(xml), xml)) AS text FROM d GROUP BY 1),
    said AS (SELECT legislative_item, substr(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:8], ' '), 1, 4000) AS summary
      FROM best WHERE id % 70 <> 0)
    SELECT 'HE ' || n AS eduskunta_tunnus, 'HE' AS doc_type, CASE WHEN summary IS NOT NULL THEN 'Bill HE ' || n END AS title, coalesce(summary, '') AS summary,
    'https://www.eduskunta.fi/FI/vaski/HallituksenEsitys/Sivut/HE_' || n || '.aspx' AS url
    FROM (SELECT DISTINCT p_partkey // 20 AS n FROM part WHERE (p_partkey // 20) % 5 <> 1) LEFT JOIN said ON legislative_item = 'HE ' || n""")
def _(b):
    have = b.vote_head.where("vote_id div 20 % 5 = 1").select(F.col("legislative_item").alias("eduskunta_tunnus"))
    texts = xml_rows.bill_texts(xml_rows.longest_document(bill_documents(b), "eduskunta_tunnus"))
    return loads.legislation_table(loads.missing_items(b.vote_head, have), texts)


# --- promises, survey ------------------------------------------------------------------
@query("src_promises_json", f"""WITH raw AS (SELECT id AS promise_id, CASE WHEN id % 2 = 0 THEN id * 3 END AS vote_id, CASE WHEN id % 2 = 1 THEN 'HE ' || (n * 5 + id % 5) END AS item
      FROM promise, (SELECT DISTINCT p_partkey // 100 AS n FROM part) t WHERE id % 2 = 1 OR n = 0),
    v AS (SELECT *, title ILIKE '%hyväksy%' OR title ILIKE '%hylk%' AS dec, max(cast(title ILIKE '%hyväksy%' OR title ILIKE '%hylk%' as int)) OVER (PARTITION BY legislative_item) AS any_dec
      FROM vote WHERE is_procedural = 0)
    SELECT promise_id, vote_id, 'Jaa' AS expected_value, 'r' || promise_id AS rationale, 'me' AS curated_by FROM raw WHERE vote_id IS NOT NULL
    UNION ALL SELECT promise_id, v.vote_id, 'Jaa', 'r' || promise_id, 'me' FROM raw JOIN v ON v.legislative_item = raw.item WHERE dec OR any_dec = 0
    UNION ALL SELECT promise_id + 100, vote_id, 'Ei', 'kept', 'older' FROM promise_vote_map""")
def _(b):
    n = b.base("part").selectExpr("p_partkey div 100 AS n").distinct()
    by_item = n.select("n", F.explode(F.array(*[F.lit(i) for i in range(1, 25, 2)])).alias("promise_id")).selectExpr(
        "cast(promise_id as bigint) AS promise_id", "cast(null as bigint) AS vote_id",
        "concat('HE ', cast(n * 5 + promise_id % 5 as string)) AS legislative_item")
    direct = b.promise.where("id % 2 = 0").selectExpr("id AS promise_id", "id * 3 AS vote_id", "cast(null as string) AS legislative_item")
    lines_ = by_item.unionByName(direct).select(F.array(F.struct(
        "promise_id", "vote_id", "legislative_item", F.lit("Jaa").alias("expected_value"),
        F.concat(F.lit("r"), "promise_id").alias("rationale"), F.lit("me").alias("curated_by"))).alias("promise_vote_map"))
    path = landed_json(lines_, "promise-map")
    b.promise.select(F.array(F.struct("id", "party_code", "text")).alias("promises")).write.mode("append").json(path)
    promises_, mapping = loads.read_promises(b.spark, path, multi_line=False)
    known = promises_.select(F.col("id").alias("promise_id"))
    resolved = loads.resolve_mappings(mapping.join(known, "promise_id", "left_semi"), b.vote_head)
    # an earlier load: mappings of the same promises, which go, and of others, which stay
    old = b.promise_vote_map.withColumns({"expected_value": F.lit("Ei"), "rationale": F.lit("kept"), "curated_by": F.lit("older")})
    previous = old.unionByName(old.withColumn("promise_id", F.col("promise_id") + 100))
    return loads.reloaded_mappings(previous, promises_, resolved).select("promise_id", "vote_id", "expected_value", "rationale", "curated_by")


@query("src_survey_csv", "SELECT party, statement_id, answer FROM survey_long")
def _(b):
    from votemill.operators import survey
    path = fresh_path(b.spark, "survey")
    (b.survey_wide.withColumn("Ikä", F.lit("40")).withColumn("lyhyt", F.lit("3"))
     .write.option("header", True).option("sep", ";").csv(path))
    wide, party, statements = loads.read_survey(b.spark, path)
    return survey.unpivot_answers(wide, party, statements)


# --- verified claims ----------------------------------------------------------------------
@query("src_stances_json", """SELECT speech_id, person_id, legislative_item, proposition, stance, evidence_quote, CASE WHEN speech_id % 5 = 0 THEN confidence ELSE confidence / 2 END AS confidence, 'demo' AS model
    FROM stance""")
def _(b):
    """Two claims per speech and proposition: the later one wins unless its quote is invented."""
    def claim(quote, conf):
        return F.struct("speech_id", "legislative_item", "proposition", "stance", quote.alias("evidence_quote"), conf.alias("confidence"))

    later = F.when(F.col("speech_id") % 5 == 0, F.lit("invented quote xyzzy")).otherwise(F.col("evidence_quote"))
    doc = b.stance.select(F.lit("demo").alias("model_label"),
                          F.array(claim(F.col("evidence_quote"), F.col("confidence")), claim(later, F.col("confidence") / 2)).alias("stances"))
    claims = loads.read_claims(b.spark, landed_json(doc, "stances"), loads.STANCE_FILE, "stances", multi_line=False)
    return loads.verified_stances(claims, b.speech).drop("conditional_note")


@query("src_explainers_json", """SELECT legislative_item, 'changes ' || legislative_item AS what_changes, 'all' AS who_affected, external_key AS ref, 'demo' AS model,
      CASE WHEN id % 5 = 1 AND next_text IS NOT NULL THEN right(text, 12) || ' ' || left(next_text, 12) ELSE right(text, 20) END AS quote
    FROM bill_speech WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY legislative_item ORDER BY id DESC) = 1""")
def _(b):
    """A claim from every speech, in one document per bill: some quote over the seam to the next speech, some are invented, the last verified one stays."""
    ahead = W.partitionBy("legislative_item").orderBy("id")
    seam = F.concat(F.expr("right(text, 12)"), F.lit(" "), F.expr("left(next_text, 12)"))
    quote = F.when((F.col("id") % 5 == 1) & F.col("next_text").isNotNull(), seam).otherwise(F.expr("right(text, 20)"))
    own = F.struct(F.lit("puhe").alias("type"), F.col("external_key").alias("ref"), quote.alias("quote"))
    extra = F.struct(F.lit("puhe").alias("type"), F.lit("x").alias("ref"), F.when(F.col("id") % 3 == 0, "invented quote xyzzy").alias("quote"))
    claim = F.struct("id", F.struct("legislative_item", F.concat(F.lit("changes "), "legislative_item").alias("what_changes"), F.lit("all").alias("who_affected"),
                                    F.lit(None).cast("string").alias("contested"), F.array(own, extra).alias("sources")).alias("claim"))
    claims_of = b.speech.withColumn("next_text", F.lead("text").over(ahead)).select("legislative_item", claim.alias("c"))
    doc = claims_of.groupBy("legislative_item").agg(F.sort_array(F.collect_list("c")).alias("cs")).select(F.lit("demo").alias("model_label"), F.col("cs.claim").alias("explainers"))
    claims = loads.read_claims(b.spark, landed_json(doc, "explainers"), loads.EXPLAINER_FILE, "explainers", multi_line=False)
    out = loads.verified_explainers(claims, b.speech, b.legislation)
    first = S.json_list(F.col("sources_json"), "struct<ref:string,quote:string>")[0]
    return out.select("legislative_item", "what_changes", "who_affected", "model", first["ref"].alias("ref"), first["quote"].alias("quote"))


@query("src_proscons_json", """SELECT v.vote_id, CASE WHEN v.vote_id % 12 = 0 THEN f.q_for ELSE l.q_for END AS pro_quote, 'demo' AS model FROM vote v
    JOIN bill_speech f ON f.legislative_item = v.legislative_item AND f.nth = 1 JOIN bill_speech l ON l.legislative_item = v.legislative_item AND l.nth_last = 1""")
def _(b):
    """Two claims for every vote, out of its bill's first and last speech; the later one wins unless a quote of it is invented."""
    def args(side, argument, quote):
        return F.array(F.struct(F.lit(argument).alias("argument"), F.col(f"{side}.speaker").alias("speaker"), F.col(f"{side}.party").alias("party"), quote.alias("quote")))

    def claim(side, against):
        return F.struct("vote_id", F.lit("n").alias("note"), args(side, "for", F.col(f"{side}.for")).alias("pro"), args(side, "against", against).alias("con"))

    wrong = F.when(F.col("vote_id") % 12 == 0, F.lit("invented quote xyzzy")).otherwise(F.col("last.against"))
    doc = b.vote_head.select("vote_id", "legislative_item").join(b.bill_arguments, "legislative_item").select(
        F.lit("demo").alias("model_label"), F.array(claim("first", F.col("first.against")), claim("last", wrong)).alias("proscons"))
    claims = loads.read_claims(b.spark, landed_json(doc, "proscons"), loads.PROSCONS_FILE, "proscons", multi_line=False)
    out = loads.verified_proscons(claims, b.vote_head, b.speech)
    return out.select("vote_id", S.json_list(F.col("pro_json"), "struct<quote:string>")[0]["quote"].alias("pro_quote"), "model")


@query("src_embeddings", """SELECT vec_id, cast(i - 1 as int) AS pos, round(cast(embedding[i] as double) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) AS value
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def _(b):
    return b.base("embeddings").select("vec_id", F.posexplode(search.unit_vector(F.col("embedding")))) \
        .select("vec_id", "pos", F.round("col", 6).alias("value"))


# --- work lists and sinks --------------------------------------------------------------------
@query("sink_stance_candidates", f"""SELECT id AS speech_id, legislative_item, first_name || ' ' || last_name || ' (' || party || ')' AS speaker, substr(text, 1, 2600) AS text FROM speech
    WHERE length(text) > 300 AND id NOT IN (SELECT speech_id FROM stance) AND legislative_item IN (SELECT legislative_item FROM vote WHERE is_procedural = 0 AND title = '{bind.CLEAN_TITLE}')""")
def _(b):
    path = fresh_path(b.spark, "work")
    sinks.write_work_list(stance.export_candidates(b.speech, b.vote_head, b.stance), path)
    return b.spark.read.schema("speech_id bigint, legislative_item string, speaker string, text string").json(path)


@query("sink_vote_debates", f"""SELECT t.vote_id, t.legislative_item, coalesce(substr(summary, 1, 1500), '') AS summary, cast(rn as int) AS pos, first_name || ' ' || last_name AS speaker, party, substr(text, 1, 900) AS text
    FROM (SELECT vote_id, legislative_item FROM vote WHERE is_procedural = 0 AND title = '{bind.CLEAN_TITLE}' AND legislative_item IN (SELECT legislative_item FROM stance)
      AND vote_id % 4 <> 0) t LEFT JOIN legislation ON eduskunta_tunnus = t.legislative_item
    JOIN (SELECT *, row_number() OVER (PARTITION BY legislative_item ORDER BY length(text) DESC, id) AS rn FROM speech WHERE length(text) > 300) s ON s.legislative_item = t.legislative_item AND rn <= 12""")
def _(b):
    path = fresh_path(b.spark, "debates")
    done = b.vote_head.where("vote_id % 4 = 0").select("vote_id")
    sinks.write_work_list(stance.vote_debates(b.speech, b.vote_head, b.legislation, b.stance, done), path)
    back = b.spark.read.schema("vote_id bigint, legislative_item string, summary string, "
                               "debate array<struct<pos:int,speaker:string,party:string,text:string>>").json(path)
    return back.select("vote_id", "legislative_item", "summary", F.inline("debate"))


@query("sink_rebuild", "SELECT vote_id, person_id, vote_value, vp_year FROM vote_record JOIN vote USING (vote_id)")
def _(b):
    path = fresh_path(b.spark, "rebuild")
    rec = b.vote_record.join(b.vote_head.select("vote_id", "vp_year"), "vote_id").select("vote_id", "person_id", "vote_value", "vp_year")
    sinks.rebuild(rec.withColumn("vote_value", F.lit("old")), path, ["vp_year"])
    sinks.rebuild(rec, path, ["vp_year"])
    return b.spark.read.schema(rec.schema).parquet(path)


@query("sink_upsert", """SELECT vote_id, CASE WHEN vote_id % 3 = 0 THEN 'new' ELSE title END AS title, 'first' AS kept FROM vote""")
def _(b):
    path = fresh_path(b.spark, "upsert")
    base = b.vote_head.select("vote_id", "title")
    table = KeyedTable(b.spark, path, ["vote_id"]).upsert(base, 0)
    merged = table.upsert(base.where("vote_id % 3 = 0").withColumn("title", F.lit("new")), 1).current()
    ignored = R.upsert(base.select("vote_id", F.lit("first").alias("kept")), base.select("vote_id", F.lit("second").alias("kept")), ["vote_id"], last_wins=False)
    return merged.join(ignored, "vote_id")


@query("sink_ingest_state", """SELECT job, cast(last_pk as varchar) AS last_pk, status, n_items, cast(note as varchar) AS note FROM (SELECT 'votes:' || (l_orderkey % 50) AS job,
    arg_max(l_partkey, seq) FILTER (l_partkey % 2 = 0) AS last_pk, arg_max(l_returnflag, seq) FILTER (l_returnflag <> 'N') AS status,
    coalesce(arg_max(l_suppkey, seq) FILTER (l_linenumber > 2), 0) AS n_items, arg_max(l_shipdate, seq) FILTER (false) AS note FROM (SELECT *, l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 8 + l_linenumber AS seq FROM lineitem) GROUP BY 1)""")
def _(b):
    log = b.base("lineitem").selectExpr(
        "concat('votes:', cast(l_orderkey % 50 as string)) AS job", "l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 8 + l_linenumber AS seq",
        "CASE WHEN l_partkey % 2 = 0 THEN cast(l_partkey as string) END AS last_pk", "cast(null as int) AS last_page",
        "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS status", "CASE WHEN l_linenumber > 2 THEN l_suppkey END AS n_items",
        "cast(null as string) AS note")
    return sinks.progress_state(log).drop("last_page")


# --- cache and photos -----------------------------------------------------------------------
@query("cache_lookup", """WITH k AS (SELECT id, sha256('m' || chr(0) || 's' || chr(0) || text || chr(0) || '{}' || chr(0)) AS key, id % 3 = 0 AS cached FROM speech),
    c AS (SELECT DISTINCT key FROM k WHERE cached), g AS (SELECT key, min(id) AS f FROM k WHERE key NOT IN (SELECT key FROM c) GROUP BY 1 ORDER BY f LIMIT 50)
    SELECT id AS request_id, key, CASE WHEN key IN (SELECT key FROM c) THEN 'hit' WHEN key IN (SELECT key FROM g) THEN 'pending' ELSE 'over_budget' END AS status FROM k""")
def _(b):
    req = b.speech.select(F.col("id").alias("request_id"), F.lit("m").alias("model"), F.lit("s").alias("system"),
                          F.col("text").alias("user"), F.lit("{}").alias("schema_json"))
    cache = (req.where("request_id % 3 = 0")
             .select(loads.cache_key(*[F.col(c) for c in ("model", "system", "user", "schema_json")]).alias("key"))
             .distinct().withColumn("response_json", F.lit("{}")))
    return loads.cache_lookup(req, cache, 50).select("request_id", "key", "status")


@query("photo_title_resolve", """WITH RECURSIVE e AS (SELECT c_custkey AS f, CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 4 ELSE c_custkey + 1 END AS t FROM customer WHERE c_custkey % 5 <> 4 OR c_custkey % 10 = 9),
    w AS (SELECT c_custkey AS k, c_custkey AS cur, [c_custkey] AS seen, false AS done FROM customer
      UNION ALL SELECT k, e.t, list_append(seen, e.t), list_contains(seen, e.t) FROM w JOIN e ON e.f = w.cur WHERE NOT done)
    SELECT k AS person_id, 'https://x.example/commons/thumb/a/ab/F' || cur || '.jpg/320px.jpg' AS photo_url, 'https://commons.wikimedia.org/wiki/File:F' || cur || '.jpg' AS photo_credit_url
    FROM w WHERE done OR NOT EXISTS (SELECT 1 FROM e WHERE e.f = w.cur)""")
def _(b):
    c = b.base("customer").select("c_custkey")
    k = F.col("c_custkey")

    def name(x):
        return F.concat(F.lit("Customer "), x.cast("string"))

    edges = c.where((k % 5 != 4) | (k % 10 == 9)).select(name(k).alias("from"), name(F.when(k % 10 == 9, k - 4).otherwise(k + 1)).alias("to"))
    thumbs = c.select(name(k).alias("title"), F.concat(F.lit("https://x.example/commons/thumb/a/ab/F"), k, F.lit(".jpg/320px.jpg")).alias("thumb"))
    people = c.select(k.alias("person_id"), name(k).alias("full_name"))
    return loads.photos(people, edges, thumbs).drop("title")


# --- streams ------------------------------------------------------------------------------
def landing(b, df: DataFrame, name: str) -> tuple[str, str, str]:
    root = fresh_path(b.spark, name)
    df.write.parquet(f"{root}/landing")
    return f"{root}/landing", f"{root}/table", f"{root}/checkpoint"


@query("stream_incremental_ingest", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def _(b):
    """Two runs over a landing folder: the second takes only what arrived in between."""
    li = b.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    src, table, ck = landing(b, li.where("l_orderkey % 2 = 0"), "ingest")
    ingest.run_available(ingest.landed(b.spark, src, li.schema), table, ck)
    li.where("l_orderkey % 2 <> 0").write.mode("append").parquet(src)
    ingest.run_available(ingest.landed(b.spark, src, li.schema), table, ck)
    return b.spark.read.schema(li.schema).parquet(table)


@query("stream_dedupe", "SELECT vote_id, person_id, vote_value FROM vote_record")
def _(b):
    """Raw records with repeated pairs, then conflicting copies in a later run; the first of each (vote, person) stays."""
    rec = b.raw_record.withColumn("vote_value", S.vote_value(F.col("vote_value")))
    src, path, ck = landing(b, rec, "dedupe")
    table = KeyedTable(b.spark, path, ["vote_id", "person_id"])
    for again in (None, rec.where("vote_id % 2 = 0").withColumn("vote_value", F.lit("later"))):
        if again is not None:
            again.write.mode("append").parquet(src)
        table = ingest.run_first_seen(ingest.landed(b.spark, src, rec.schema), table, ck, ["page", "place"])
    return table.current().select("vote_id", "person_id", "vote_value")


@query("stream_dedupe_window", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(b):
    """Every row lands twice, hours apart; keys are remembered for 30 days of event time and let go afterwards."""
    li = b.base("lineitem").select("l_orderkey", "l_linenumber", F.to_timestamp(F.lit("2024-01-01")).alias("seen_at"))
    src, path, ck = landing(b, li.unionByName(li.withColumn("seen_at", F.col("seen_at") + F.expr("interval 5 hours"))), "window")
    shape = ingest.deduplicated(["l_orderkey", "l_linenumber"], "seen_at")
    ingest.run_available(ingest.landed(b.spark, src, li.schema), path, ck, shape)
    return b.spark.read.schema(li.schema).parquet(path).select("l_orderkey", "l_linenumber")


@query("stream_upsert", "SELECT vote_id, CASE WHEN vote_id % 3 = 0 THEN title || ' (uusi)' ELSE title END AS title FROM vote")
def _(b):
    """Two loads, the second of a lost checkpoint: it reads all files again, and of the rows of one batch the least aged counts."""
    head = b.vote_head.select("vote_id", "title", F.lit(1).alias("age"))
    src, path, ck = landing(b, head, "upsert")
    table = ingest.run_upserts(ingest.landed(b.spark, src, head.schema), KeyedTable(b.spark, path, ["vote_id"]), ck, ["age"])
    head.where("vote_id % 3 = 0").select("vote_id", F.concat("title", F.lit(" (uusi)")).alias("title"), F.lit(0).alias("age")).write.mode("append").parquet(src)
    table = ingest.run_upserts(ingest.landed(b.spark, src, head.schema), table, f"{ck}-renewed", ["age"])
    return table.merge().current().drop("age")
