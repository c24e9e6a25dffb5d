from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from votemill import constants as C
from votemill.functions import scalars as S, text as X
from votemill.operators import language, search, topics


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "t string").select(*cols).first()


def assign(spark, text):
    got = topics.assign_topics(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()
    return {r.topic_id: r for r in got}, [s for _, s, _, _ in topics.default_lexicon()]


def primary(spark, text):
    got, slugs = assign(spark, text)
    return next((slugs[i - 1], r.status) for i, r in got.items() if r.is_primary)


def test_lexicon_size():
    lex = topics.default_lexicon()
    kws = [k for _, _, _, ks in lex for k, _ in ks]
    assert len(lex) == 16 and len(kws) == 120 and sum(" " in k for k in kws) == 27
    assert len(language.default_stopwords()) > 200


def test_topics(spark):
    assert primary(spark, "Terveydenhuollon rahoitus ja hoitotakuu. Sairaalat ja lääkärit ja hoitajat.")[0] == "terveydenhuolto"
    assert primary(spark, "Kissa istui maton päällä ja katseli ulos ikkunasta hiljaa.") == ("muu", "NO_MATCH")
    assert primary(spark, "Hei vaan kaikille.")[0] == "muu"
    assert primary(spark, None)[0] == "muu"
    got, slugs = assign(spark, "Julkinen talous ja julkis taloutemme alijäämä sekä valtiontalous huolettavat.")
    assert "talous" in [slugs[i - 1] for i in got] and len(got) <= 3


def test_tokens(spark):
    r = one(spark, "Arvoisa <b>puhemies</b>! Lähi-idän ÄÄNI_1, 2²", X.tokens(F.col("t")).alias("x"))
    assert r.x == ["arvoisa", "puhemies", "lähi-idän", "ääni_1", "2²"]
    assert one(spark, "äa", X.nfc(F.col("t")).alias("x")).x == "äa"


def test_overlapping_positions(spark):
    line = X.token_line(F.col("t"))
    r = one(spark, "eu eu eu komissio", X.prefix_count(line, "eu eu").alias("two"), X.prefix_count(line, "eu eu kom").alias("three"),
            X.prefix_count(line, "eu").alias("one"), X.line_length(line).alias("n"))
    assert (r.two, r.three, r.one, r.n) == (2, 1, 3, 4)
    assert one(spark, "", X.line_length(line).alias("n")).n == 0


WORDS = st.lists(st.sampled_from(["no", "niin", "eu", "eun", "totta", "kai"]), max_size=12)


def test_counts_against_plain_python(spark):
    cases = []

    @settings(max_examples=60, database=None)
    @given(WORDS)
    def collect(ws):
        cases.append(ws)

    collect()
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(cases)], "i int, t string")
    hits = X.lexicon_hits(X.tokens(F.col("t")), ["no", "eu"], ["no niin", "totta kai", "no no"])
    got = df.select("i", X.prefix_count(X.token_line(F.col("t")), "eu n").alias("p"), F.size(hits).alias("h")).collect()
    for r in got:
        w = cases[r.i]
        pairs = list(zip(w, w[1:]))
        assert r.p == sum(a.startswith("eu") and b.startswith("n") for a, b in pairs)
        assert r.h == sum(x in ("no", "eu") for x in w) + sum(" ".join(p) in ("no niin", "totta kai", "no no") for p in pairs)


def test_filler_counts_as_word_and_phrase(spark, seed):
    s = spark.createDataFrame([(1, "Tuota noin, no niin. Tuota!")], "person_id long, text string")
    r = {x.category: x for x in language.word_style(language.style_counts(s), seed.person).collect()}
    assert r["filler"].n_hits == 4 and r["filler"].n_words == 5 and r["swear"].n_hits == 0


def test_scalars(spark):
    t = F.col("t")
    assert one(spark, "24.3.1995", S.fi_date(t).alias("x")).x == "1995-03-24"
    assert one(spark, "epäkelpo", S.fi_date(t).alias("x")).x is None
    assert one(spark, "sd01", S.normalize_party(t).alias("x")).x == "sd"
    assert one(spark, "kok       ", S.normalize_party(t).alias("x")).x == "kok"
    assert one(spark, "Suomen Keskusta ", S.party_code(t).alias("x")).x == "kesk"
    assert one(spark, "tuntematon", S.party_code(t).alias("x")).x is None
    assert str(one(spark, "2024-02-25T10:00:00", S.iso_day(t).alias("x")).x) == "2024-02-25"
    assert one(spark, "2024-13-45", S.iso_day(t).alias("x")).x is None
    assert one(spark, "https://u/commons/thumb/a/ab/X.jpg/320px-X.jpg", S.file_page_url(t).alias("x")).x.endswith("wiki/File:X.jpg")
    assert one(spark, "rikki [", F.size(S.json_list(t, "string")).alias("x")).x == 0
    assert one(spark, "Asian palauttaminen", S.is_procedural(t).alias("x")).x == 1
    assert one(spark, "HE 1/2024 vp", S.doc_type(t).alias("x")).x == "HE"
    for title, want in (("Hyväksyminen / Hylkääminen", True), ("Mietintö / X hylkäysehdotus", True),
                        ("Mietintö / Lauri, lausumaehdotus", False), ("ehdotus / ehdotus", False), (None, False)):
        assert one(spark, title, S.is_bill_passage(t).alias("x")).x is want
    assert one(spark, "Ei. Hampaat irvessä äänestän", S.reluctance(t, C.RELUCTANCE_MARKERS).alias("x")).x == "hampaat irvessä"


def test_bm25_ranks_and_snippet(spark, seed, tmp_path):
    index = search.build_index(seed.speech, "id", "text", str(tmp_path / "index"))
    hits = search.retrieve(index, seed.speech, "hoitotakuu potilaat", k=5).collect()
    assert [h.id for h in hits] == [3, 1] and hits[0].score > hits[1].score
    assert search.retrieve(index, seed.speech, "", k=5).count() == 0
    (s,) = search.search_speeches(index, seed.speech, "VEROTUS").collect()
    assert s.snip.startswith("<mark>Verotus</mark>")


def test_snippet_cuts_a_text_once_and_looks_at_the_words_of_the_window_only(spark):
    words = ["\u0301", "x" * 3, "ΟΔΟΣ", "😀", "quex", "-"] * 4 + ["(QUÉ)"] + ["y", "qu\u0301e-z", "\u0301\u0302"] * 5
    texts = [" " + "\n ".join(words) + "\t", "que", "  quex\t", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    terms = F.array(*[F.lit(t) for t in ("thon", "que", "a-b")])
    got = df.select("id", X.snippet(F.col("text"), terms).alias("snip"))
    mark = [f"<mark>{w}</mark>" if w in ("(QUÉ)", "qu\u0301e-z") else w for w in words[24:36]]
    assert {r.id: r.snip for r in got.collect()} == {0: "…" + " ".join(mark) + "…", 1: "<mark>que</mark>", 2: None, 3: None, 4: None}
    assert got._jdf.queryExecution().analyzed().toString().count("split(") == 2


def test_phrases_and_pruned_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "EU-jäsen maksaa"), (2, "jäsen EU"), (3, "eu ja jäsen"), (4, "Sørensen e\u0301 x")], "id long, text string")
    assert search.fold_phrases('EU-jäsen "Mentré" ø-x') == [["eu", "jasen"], ["mentre"], ["ø", "x"]]
    index = search.build_index(docs, "id", "text", str(tmp_path / "index"))
    assert [r.id for r in search.bm25(index, [["eu", "jasen"]]).collect()] == [1]
    assert [r.id for r in search.bm25(index, [["sørensen"], ["e"]], require_all=True).collect()] == [4]
    assert search.bm25(index, []).count() == 0
    plan = index.blocks(["eu"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,eu)" in plan


def test_candidates_count_like_the_whole_line(spark):
    """Every keyword of a lexicon, from one pass over the line; nested prefixes, phrases, shared first parts."""
    keys = ["eu", "e", "eun", "no niin", "no no", "tot", "totta kai no", "kai", "a.b", "no"]
    cases = []

    @settings(max_examples=80, database=None)
    @given(WORDS)
    def collect(ws):
        cases.append(ws)

    collect()
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(cases)], "i int, t string")
    lines = df.select("i", X.token_line(F.col("t")).alias("l"))
    both = lines.select(F.array(*[X.prefix_count(F.col("l"), k) for k in keys]).alias("plain"), X.candidate_line(F.col("l"), keys).alias("c"))
    for r in both.select("plain", F.array(*[X.candidate_count(F.col("c"), k) for k in keys]).alias("quick")).collect():
        assert r.plain == r.quick


def test_composition_only_where_needed(spark):
    texts = ["plain", "école", "été", None, "", "한글", "한", "𝒳 ä"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    import unicodedata
    got = {r.i: r.x for r in df.select("i", X.nfc(F.col("t")).alias("x")).collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
