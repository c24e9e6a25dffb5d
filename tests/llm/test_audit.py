"""Filter audit against a plain version, and its relations."""

from collections import Counter

from pyspark.sql import functions as F

import brute
from votemill.llm import filter_audit, queries

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_op11_on_awkward_rows(spark, nasty):
    docs = _rows(spark.read.parquet(f"{nasty}/documents.parquet"), "doc_id", "text", "source")
    labels = _rows(spark.read.parquet(f"{nasty}/labels.parquet"), "doc_id", "quality", "toxic")
    got = queries.op11_filter_audit(spark, nasty)
    assert Counter(_rows(got, *COLUMNS)) == brute.audit(docs, labels)


def test_every_combination_of_failures(spark):
    """All 32 sets of failing filters, in parts of unequal size; one part that no row of fails."""
    texts = []
    for bits in range(32):
        n = 150 if bits & 1 else 220
        words = ["w"] * n if bits & 2 else [f"w{k}" for k in range(n)]
        if bits & 4:
            words = [w.upper() for w in words]
        texts.append(" ".join(words) + (" 5%" if bits & 8 else "") + f" z{bits}")
    rows = [(k, t, "few" if k % 3 else "many") for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k], None) for k in range(0, 32, 2)] + [(100, texts[0], None), (None, texts[1], "many")]
    rows += [(900, " ".join(f"x{k}" for k in range(300)), "clean")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(40)] + [(4, 0, 1), (5, None, None), (100, 1, 1), (100, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame([(i, q, t if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    facts = filter_audit.text_filters(docs, marks)
    tables = filter_audit.failing_ids(facts, {f: F.col(f) for f in "ABCDE"})
    want = brute.audit(rows, labels)
    assert Counter(_rows(filter_audit.audit(facts, tables), *COLUMNS)) == want
    left = Counter(r.part for r in filter_audit.survivors(facts, tables, "CAE").collect())
    assert all(left[part] == kept for part, order, step, kept, *_ in want if order.startswith("CAE") and step == 3)


def test_the_filters_are_the_callers(spark):
    """Two filters of another table: names, ids and labels as given."""
    rows = spark.createDataFrame([(k, "p", k % 2 == 0, False, k % 2 == 0, k % 3 == 0) for k in range(12)], "id long, part string, good boolean, toxic boolean, X boolean, Y boolean")
    tables = filter_audit.failing_ids(rows, {"X": F.col("X"), "Y": F.col("Y")})
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in filter_audit.audit(rows, tables).collect()}
    assert got == {("XY", 1): (6, 6, 0, 4, 6, 10), ("XY", 2): (4, 2, 2, 2, 0, 6), ("YX", 1): (8, 4, 0, 2, 2, 6), ("YX", 2): (4, 4, 2, 4, 4, 10)}


def test_only_failing_ids_are_dealt_out(spark, nasty):
    """The removals come from anti-joins with each table; the labels from semi-joined ids."""
    facts = filter_audit.text_filters(queries.documents(spark, nasty), spark.read.parquet(f"{nasty}/labels.parquet"))
    tables = filter_audit.failing_ids(facts, {f: F.col(f) for f in "ABCDE"})
    plan = filter_audit.removals(facts, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 5 and plan.count("Join LeftSemi") == 5
