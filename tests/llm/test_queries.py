from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from trawlspark.llm import decontaminate, quality, simhash, toxicity
from trawlspark.llm.common import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if k.startswith("op")))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.01"
    df = __spark_entry__.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(r.fetchall(), key=repr)


def test_base_rules_match_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = quality.base(table(spark, sf, "documents")).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(quality.base_sql()).fetchall())


def test_ten_queries_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names


def test_pipeline_is_its_operators_decisions(spark, sf):
    docs, labels, bench = (table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    left = docs.where(~docs.doc_id.isin(list(toxic))) if toxic else docs
    bad = {r.doc_id for r in quality.ruled(left, labels).where("not kept").collect()}
    left = left.where(~left.doc_id.isin(list(bad)))
    first = {r.component_id for r in simhash.near_duplicates(left).collect()}
    left = left.where(left.doc_id.isin(list(first)))
    leaks = {r.doc_id for r in decontaminate.digest(decontaminate.contamination(left, bench)).where("contaminated").collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(first - leaks) and got
    assert leaks and bad  # so few labels show no significant feature
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-dedup", "decontamination", "byte-level BPE"]


def test_stages_take_nulls_empty_tables_and_other_columns(spark, sf):
    docs = spark.createDataFrame([(None, None, 1, "a"), (1, "", 2, "b"), (1, "", 2, "b"), (2, "w " * 30, 3, None)], "doc_id long, text string, row int, `a.b` string")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, df, sf).columns == df.columns
            stage(spark, df, sf).collect()
