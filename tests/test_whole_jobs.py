"""Rows that a cut by ids, places or repeated keys would lose."""

import datetime

from folio_spark.plans import library, texts

def test_progress_of_books_with_large_keys(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    tables = {
        "orders": ([(k, 1, "F", "1-URGENT", 1000.0) for k in (199, 200, 70000)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double"),
        "events": ([(i, at, k, "view", 1.0, '{"k": 7}') for i, k in enumerate((199, 200, 70000))], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "lineitem": ([(k, p) for k in (199, 200, 70000, 80000) for p in (107, 9)], "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((r["book_url"], r["title"], r["total"], r["last_title"]) for r in library.j10(spark, str(tmp_path)).collect())
    assert got == [(f"/o/{k}", "Chapter 107", 2, "Chapter 9") for k in (199, 200, 70000)]


def test_all_places_of_a_frequent_word(spark, tmp_path):
    spark.createDataFrame([(1, "this " * 1500), (2, "none"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["place"], r["at"]) for r in texts.u16(spark, str(tmp_path)).collect())
    assert got == [(1, i + 1, 5 * i) for i in range(1500)]
