from __future__ import annotations

from trawlspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_string_functions_take_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["string_functions_whole"](spark, SF).collect()
    assert {r.doc_id: r.right_trimmed for r in got} == {k: None if t is None else f"  {t}".rstrip(" \t\n\x0b\f\r") for k, t in texts.items()}
