import pytest
from pyspark.sql import functions as F

from brute import NASTY


@pytest.fixture(scope="session")
def nasty(spark, tmp_path_factory):
    """A folder of tables with nulls, empties, long texts, ties, repeated rows and clashing extra columns."""
    folder = str(tmp_path_factory.mktemp("nasty"))
    extra = {c: F.lit(c) for c in ("row", "uid", "kind", "block", "length", "component", "score", "n", "_key", "_number", "id", "part", "fp", "x", "key")}
    docs = spark.createDataFrame(NASTY, "doc_id long, text string").withColumns(extra).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("source", F.expr("case doc_id % 3 when 0 then 'a' when 1 then '' end"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("moron" in (t or ""))) for i, t in NASTY if i is not None] + [(3, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    page = "<html>" + "same page " * 30 + "</html>"
    pages = [(5, "http://a/5", page), (3, "http://a/3", page), (9, None, page), (9, None, page), (None, "http://a/\r\nx", page), (1, "http://a/1", None),
             (2, "http://a/2", ""), (4, "http://a/4", "short"), (6, "http://a/6", "short"), (7, "http://é/7", "ü" * 40), (8, "u", "ü" * 50), (10, "u", "ü" * 50), (11, "u", "x" * 3_000_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns(extra).write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [float(x) for x in ((i * 7) % 5 - 2, (i * 3) % 7 - 3, 1, (i * i) % 11)], i) for i in range(100)]
    vectors += [(200 + i, [3.0, 3.0, 3.0, 3.0], 0) for i in range(60)]
    vectors += [(300, None, 0), (320, [0.0] * 4, 0), (340, [1.0, None, 2.0, 3.0], 0), (360, [1.0, float("nan"), 0.0, 0.0], 0), (380, [float("inf"), 0.0, 0.0, 1.0], 0), (None, [1.0] * 4, 0), (200, [3.0] * 4, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns(extra).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, nasty, tmp_path_factory):
    """The same tables without rows."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for table in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{nasty}/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    return folder
