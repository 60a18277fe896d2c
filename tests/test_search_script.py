"""The search by script looks through every text as it stands."""

import duckdb

from colloquy.plans import catalog

TEXTS = ["an 東京タワー", "none", "東京", "東 京", None, "", "see 東京 now", "seven"]


def test_every_text_is_searched(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.QUERIES["srh_03_cjk"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == con.execute(catalog.ORACLE_SQL["srh_03_cjk"]).fetchall()
    assert got == [(i, 1.0) for i, t in reversed(rows) if t and "東京" in t][:20] and len(got) == 15
