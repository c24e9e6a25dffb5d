import os
import sys

import pytest
from pyspark.sql import SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[4]").appName("votemill-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


class Seed:
    """Five members of two groups, three votes on two bills, three speeches, one promise."""

    def __init__(self, spark):
        people = [(1, "Anna", "Aalto", "kok"), (2, "Bo", "Berg", "kok"), (3, "Cecilia", "Citron", "kok"),
                  (4, "Dan", "Dahl", "sd"), (5, "Eero", "Eskola", "sd")]
        self.person = spark.createDataFrame(
            [(i, f, l, f"{f} {l}", p, p.upper(), "Alue", 0, "2015-04-22") for i, f, l, p in people],
            "person_id long, first_name string, last_name string, full_name string, party_current string, "
            "party_current_name string, electoral_district string, is_minister int, active_from string")
        votes = [(100, "2024-03-01 12:00:00", "Terveydenhuollon rahoitus, hoitotakuu", "HE 1/2024 vp"),
                 (101, "2024-04-01 12:00:00", "Verotuksen muutos, tulovero", "HE 2/2024 vp"),
                 (102, "2024-05-01 12:00:00", "Terveydenhuollon rahoitus, hoitotakuu jatko", "HE 1/2024 vp")]
        self.vote = spark.createDataFrame(
            [(v, 2024, d, t, i, "", 3, 2, 0) for v, d, t, i in votes],
            "vote_id long, vp_year int, session_date string, title string, legislative_item string, treatment_stage string, "
            "result_yes long, result_no long, is_procedural int") \
            .select("*", *[F.lit(None).cast("string").alias(c) for c in ("item_title", "main_item_title", "treatment_title", "extra_title")])
        sides = {100: "Jaa Jaa Ei Ei Ei", 101: "Jaa Jaa Jaa Ei Poissa", 102: "Jaa Jaa Jaa Ei Ei"}
        self.vote_record = spark.createDataFrame(
            [(v, i, f, l, p, x) for v, xs in sides.items() for (i, f, l, p), x in zip(people, xs.split())],
            "vote_id long, person_id long, first_name string, last_name string, party string, vote_value string")
        talks = [(1, 1, "2024-02-25T10:00:00", "HE 1/2024 vp", "Arvoisa puhemies! Terveydenhuollon rahoitus ja hoitotakuu ovat tärkeitä. "
                  "Sairaalat ja terveysasemat tarvitsevat lääkäreitä ja hoitajia."),
                 (2, 1, "2024-03-28T10:00:00", "HE 2/2024 vp", "Verotus ja tulovero ovat keskiössä. Veroaste ja yhteisövero vaikuttavat talouteen."),
                 (3, 4, "2024-02-26T10:00:00", "HE 1/2024 vp", "Puhemies! Terveydenhuolto ja hoitotakuu on turvattava. Potilaat tarvitsevat hoitoa.")]
        who = {i: (f, l, p) for i, f, l, p in people}
        self.speech = spark.createDataFrame(
            [(i, p, *who[p], f"s{i}", d, it, "PTK 1/2024 vp", "T", t, len(t.split())) for i, p, d, it, t in talks],
            "id long, person_id long, first_name string, last_name string, party string, external_key string, started_at string, "
            "legislative_item string, ptk_id string, speech_type string, text string, word_count int")
        self.legislation = spark.createDataFrame([], "eduskunta_tunnus string, title string, summary string, url string")
        self.promise = spark.createDataFrame([(1, "party", "kok", None, "Turvaamme")], "id long, scope string, party_code string, person_id long, text string")
        self.mapping = spark.createDataFrame([(1, 100, "Jaa")], "promise_id long, vote_id long, expected_value string")


@pytest.fixture(scope="session")
def seed(spark):
    return Seed(spark)
