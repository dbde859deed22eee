from __future__ import annotations

from trawlspark.llm import decontaminate


def test_items_without_an_id_are_leaks(spark):
    leak, other = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z q r s t u v"
    docs = spark.createDataFrame([(1, f"x {leak} y"), (2, "nothing of it"), (3, f"{other} {leak}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, leak), (7, other)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(docs, items)).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (1, 2, 3)] == [(16, 0, True), (0, 0, False), (32, 1, True)]
    assert got[3].items_sha256 == decontaminate.sha_of([7])
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [2]
