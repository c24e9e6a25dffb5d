import os
import subprocess
import sys

from pyspark.sql import functions as F

from votemill.operators import stance
from votemill.sources import loads, members, sinks, xml_rows
from votemill.sources.keyed import KeyedTable
from votemill.streaming import ingest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

MINUTES = """<?xml version="1.0"?>
<Siirto xmlns:m="urn:m" xmlns:v="urn:v" xmlns:k="urn:k" xmlns:s="urn:s"><Poytakirja eduskuntaTunnus="PTK 5/2024 vp">
<Asiakohta eduskuntaTunnus="HE 9/2024 vp"><k:Wrap><k:PuheenvuoroToimenpide v:puheenvuoroLuokitusKoodi="T" v:puheenvuoroAloitusHetki="2024-03-10T10:00:00">
<k:Toimija><k:Henkilo m:muuTunnus="42"/></k:Toimija><k:PuheenvuoroOsa m:muuTunnus="900"><k:KohtaSisalto>
<s:KappaleKooste>Ensimmäinen kappale.</s:KappaleKooste><s:KappaleKooste>Toinen kappale.</s:KappaleKooste>
<k:PuheenjohtajaRepliikki><s:KappaleKooste>repliikki</s:KappaleKooste></k:PuheenjohtajaRepliikki>
</k:KohtaSisalto></k:PuheenvuoroOsa></k:PuheenvuoroToimenpide></k:Wrap></Asiakohta></Poytakirja></Siirto>"""

MEMBER = """<Henkilo><Ammatti>opettaja</Ammatti><SyntymaPvm>1970</SyntymaPvm><SukuPuoliKoodi>Nainen</SukuPuoliKoodi>
<NykyinenVaalipiiri><Nimi>Helsinki</Nimi></NykyinenVaalipiiri>
<Edustajatoimet><Edustajatoimi><AlkuPvm>24.04.2019</AlkuPvm><LoppuPvm></LoppuPvm></Edustajatoimi></Edustajatoimet>
<NykyinenEduskuntaryhma><Nimi>Kokoomus</Nimi><Tunnus>kok01</Tunnus><AlkuPvm>24.04.2019</AlkuPvm></NykyinenEduskuntaryhma>
<Eduskuntaryhma><Nimi>Vihreat</Nimi><Tunnus>vihr01</Tunnus><Jasenyys><AlkuPvm>22.04.2015</AlkuPvm><LoppuPvm>23.04.2019</LoppuPvm></Jasenyys></Eduskuntaryhma>
<ValtioneuvostonJasenyydet><Jasenyys><Nimi>opetusministeri</Nimi><Hallitus>H</Hallitus></Jasenyys></ValtioneuvostonJasenyydet></Henkilo>"""


def test_minutes(spark):
    docs = spark.createDataFrame([("PTK 5/2024 vp", "2024/5", MINUTES), ("PTK 6/2024 vp", "2024/6", "<broken"), ("x", "y", None)],
                                 "ptk_id string, session_key string, xml string")
    (r,) = xml_rows.minutes_speeches(docs).collect()
    assert (r.person_id, r.speech_type, r.legislative_item, r.external_key) == (42, "T", "HE 9/2024 vp", "900")
    assert r.text == "Ensimmäinen kappale.\n\nToinen kappale." and r.word_count == 4


def test_members(spark):
    docs = spark.createDataFrame([(42, MEMBER), (43, "<oops"), (44, MEMBER.replace("kok01", "").replace("Kokoomus", ""))], "person_id long, xml string")
    prof = xml_rows.member_profiles(docs)
    r = {x.person_id: x for x in prof.collect()}
    assert (r[42].birth_year, r[42].profession, r[42].electoral_district, r[42].party_current) == ("1970", "opettaja", "Helsinki", "kok")
    assert {p.code for p in r[42].parties} == {"kok", "vihr"} and r[42].terms[0].start == "2019-04-24"
    assert r[43].birth_year is None and r[44].party_current == "vihr"
    reg = spark.createDataFrame([(42, "A ", "B", "f"), (43, "C", "D", "f")], "person_id long, firstname string, lastname string, minister string")
    out = {x.person_id: x for x in members.load_members(reg, prof, start_year=2015, end_year=2024).collect()}
    assert out[42].is_minister == 1 and out[42].full_name == "A B" and out[42].active_to is None and 43 in out
    assert members.load_members(reg, prof, start_year=2001, end_year=2010).count() == 1


def test_bills(spark):
    xml = "<A><SisaltoKuvaus>Laki</SisaltoKuvaus>" + "".join(f"<KappaleKooste>k{i}</KappaleKooste>" for i in range(12)) + "</A>"
    r = xml_rows.bill_texts(spark.createDataFrame([("HE 1", xml)], "eduskunta_tunnus string, xml string")).first()
    assert r.title == "Laki" and r.summary == " ".join(f"k{i}" for i in range(8))


def test_quotes_are_checked(spark, seed):
    claims = spark.createDataFrame(
        [("m", 0, 1, "HE 1/2024 vp", "ok", "puolesta", None, "Sairaalat ja", 0.9), ("m", 1, 1, "HE 1/2024 vp", "bad", "vastaan", None, "xyzzy", 0.5)],
        "model_label string, pos int, speech_id long, legislative_item string, proposition string, stance string, conditional_note string, evidence_quote string, confidence double")
    assert [r.proposition for r in loads.verified_stances(claims, seed.speech).collect()] == ["ok"]


def test_ledger(spark, seed):
    st = spark.createDataFrame([(1, 1, 1, "HE 9", "puolesta", "q", 0.9, "m"), (2, 1, 3, "HE 9", "vastaan", "q", 0.2, "m")],
                               "id long, speech_id long, person_id long, legislative_item string, stance string, evidence_quote string, confidence double, model string")
    vote = spark.createDataFrame([(900, "HE 9", "Hyväksyminen / Hylkääminen", "2099-01-01", "", 0), (901, "HE 9", "Mietintö / X, lausumaehdotus", "2099-01-02", "", 0)],
                                 "vote_id long, legislative_item string, title string, session_date string, treatment_stage string, is_procedural int")
    rec = spark.createDataFrame([(900, 1, "Jaa"), (901, 1, "Ei"), (900, 3, "Jaa")], "vote_id long, person_id long, vote_value string")
    got = {(r.person_id, r.vote_id): r.alignment for r in stance.words_votes_ledger(st, seed.speech, vote, rec).collect()}
    assert got == {(1, 900): "linjassa", (1, 901): "konteksti", (3, 900): "konteksti", (3, 901): "ei_riitä"}
    sure = st.withColumn("confidence", F.lit(0.9))
    got = {(r.person_id, r.vote_id): r.alignment for r in stance.words_votes_ledger(sure, seed.speech, vote, rec).collect()}
    assert got[3, 900] == "ristiriita"


def test_promise_fallback(spark):
    vote = spark.createDataFrame([(1, "A", "Hyväksyminen / Hylkääminen", 0), (2, "A", "muu", 0), (3, "B", "muu", 0), (4, "B", "hylkäys", 1)],
                                 "vote_id long, legislative_item string, title string, is_procedural int")
    m = spark.createDataFrame([(1, None, "A", "Jaa"), (2, None, "B", "Jaa"), (3, 9, None, "Ei")], "promise_id long, vote_id long, legislative_item string, expected_value string")
    assert {(r.promise_id, r.vote_id) for r in loads.resolve_mappings(m, vote).collect()} == {(1, 1), (2, 3), (3, 9)}


def test_titles_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("p", "x")], '`from` string, `to` string')
    names = spark.createDataFrame([(n,) for n in "abcxpq"], "name string")
    got = {r.name: r.title for r in loads.resolve_titles(names, edges).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": "x", "p": "x", "q": "q"}


def test_cache(spark):
    req = spark.createDataFrame([(i, "m", "s", u, "{}") for i, u in enumerate("aabcd")], "request_id long, model string, system string, user string, schema_json string")
    cache = req.where("user = 'b'").select(loads.cache_key(*[F.col(c) for c in ("model", "system", "user", "schema_json")]).alias("key"), F.lit("{}").alias("response_json"))
    got = [r.status for r in loads.cache_lookup(req, cache, 2).orderBy("request_id").collect()]
    assert got == ["pending", "pending", "hit", "pending", "over_budget"]


def test_progress(spark):
    log = spark.createDataFrame([("j", 1, "5", None, "running", 3, None), ("j", 2, None, None, "done", None, "n")],
                                "job string, seq long, last_pk string, last_page int, status string, n_items long, note string")
    r = sinks.progress_state(log).first()
    assert (r.last_pk, r.status, r.n_items, r.note) == ("5", "done", 3, "n")


def test_stream_resumes_and_dedupes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    for part in (df.where("id < 6"), df.where("id > 3")):
        part.write.mode("append").parquet(src)
        ingest.run_available(ingest.landed(spark, src, df.schema), out, ck, ingest.deduplicated(["id"]))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_first_copy_stays(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "k int, place int, v string"
    table = KeyedTable(spark, out, ["k"])
    for rows in ([(1, 2, "b"), (1, 1, "a"), (2, 1, "x")], [(1, 0, "z"), (3, 1, "n")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        table = ingest.run_first_seen(ingest.landed(spark, src, spark.createDataFrame([], schema).schema), table, ck, ["place"])
    assert {(r.k, r.v) for r in table.current().collect()} == {(1, "a"), (2, "x"), (3, "n")}


def test_lost_checkpoint_and_merge(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    rows = lambda t: {(r.k, r.v) for r in t.current().collect()}
    df((1, "a"), (2, "b")).write.parquet(src)
    table = ingest.run_upserts(ingest.landed(spark, src, df((1, "")).schema), KeyedTable(spark, out, ["k"]), str(tmp_path / "ck1"))
    other = str(tmp_path / "src2")
    df((2, "c"), (3, "d")).write.parquet(other)
    table = ingest.run_upserts(ingest.landed(spark, other, df((1, "")).schema), table, str(tmp_path / "ck2"))
    want = {(1, "a"), (2, "c"), (3, "d")}
    assert rows(table) == want
    table = table.merge()
    assert rows(table) == want
    table = table.upsert(df((3, "e")), 0, table.run_number(str(tmp_path / "ck3")))
    assert rows(table) == {(1, "a"), (2, "c"), (3, "e")}
    table = table.merge().merge()
    assert rows(table) == {(1, "a"), (2, "c"), (3, "e")}


def test_workers_get_the_package_without_a_path(tmp_path):
    """A process elsewhere, with the package on the driver's path only and no shared folder named."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "from votemill.plans import registry\n"
            "q = registry.queries()\n"
            "print('rows', q['src_members_xml'](s, '/root/testdata/sf0.001').count(), q['stream_upsert'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 10 200" in done.stdout, done.stderr[-2000:]
