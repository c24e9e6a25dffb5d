"""Card rarity counts the speeches that a member has held."""

import shutil

import duckdb

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_many_speeches_make_a_card_rare(spark, tmp_path):
    sf = str(shutil.copytree(SF, tmp_path / "tables"))
    con = duckdb.connect()
    for name in ("supplier", "documents"):
        (tmp_path / "tables" / f"{name}.parquet").unlink()
    con.execute(f"COPY (SELECT i AS s_suppkey, 'Supplier#' || i AS s_name, i % 5 AS s_nationkey, 0.0::double AS s_acctbal FROM range(50) t(i)) TO '{sf}/supplier.parquet'")
    # 7 * 43 is 1 modulo 50, so these are 400 speeches of member 33, 399 of member 34 and one of member 36
    held = " UNION ALL ".join(f"SELECT ({m} * 43) % 50 + 50 * i AS doc_id, 'some words' AS text, 'en' AS lang FROM range({n}) t(i)" for m, n in ((33, 400), (34, 399), (36, 1)))
    con.execute(f"COPY (SELECT *, 'web' AS source, length(text) AS n_chars FROM ({held})) TO '{sf}/documents.parquet'")
    out = entry.queries()["fn_card_flair"](spark, sf)
    rarity = {r.person_id: r.rarity for r in out.collect()}
    assert [rarity[m] for m in (33, 34, 36, 40, 3)] == ["harvinainen", "perus", "perus", "legendaarinen", "harvinainen"]
    assert compare(out, connect(sf), entry.oracle_sql()["fn_card_flair"])[0] == ""
