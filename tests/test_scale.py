"""Steps whose cost or memory once grew faster than the input."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawlspark.functions import inverted as I
from trawlspark.functions import text as T
from trawlspark.functions.markup import machine
from trawlspark.operators import batch as B
from trawlspark.operators import metrics as M
from trawlspark.operators import search as S
from trawlspark.operators.impacts import build_impacts
from trawlspark.operators.index import SearchIndex, spread
from trawlspark.sources.documents import from_table

random.seed(3)
WORDS = "the sea a white whale ship storm U.S. don't well-known x".split()
TEXTS = [" ".join(random.choice(WORDS) + random.choice(["", "", ".", ",", "!"]) for _ in range(random.randint(0, 30))) for _ in range(60)]


def collection(spark, texts):
    return from_table(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")


@pytest.fixture(scope="module")
def index(spark):
    return SearchIndex.build(collection(spark, TEXTS), "none")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def rows(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(["text/html"] * n), pa.array(texts)], names=["docno", "aux", "source", "type", "raw"])


def test_array_arithmetic_finds_what_the_lexer_does():
    some = ["".join(random.choice("aB1.!?-,'\x00\x01é \n\t\x1c&;<>/x") for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["z" * 50 + ". a", "", "é", "U.S. A. b"]
    got = [[(o["term"], o["pos"]) for o in x] for s in I.slices([rows(some)]) for x in s.occurrences().to_pylist()]
    assert got == [machine("text/html").one(t, 0, 0).occurrences for t in some]


def test_memory_follows_the_slice_not_the_batch(monkeypatch):
    monkeypatch.setattr(I, "SLICE", 1000)
    monkeypatch.setattr(I, "ROWS", 7)
    found = list(I.slices([rows(TEXTS)]))
    assert len(found) > 5 and sum(s.rows.num_rows for s in found) == len(TEXTS)
    assert all(b.num_rows <= 7 for s in found for b in s.postings())


def test_postings_are_made_without_a_shuffle(index):
    import trawlspark.operators.index as X

    for df in (X.inverted(collection(index.spark, TEXTS), "light", ["the"]), X.parsed(collection(index.spark, TEXTS), "light")):
        assert "Exchange" not in plan(df) and "Aggregate" not in plan(df)


def test_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("docno"), F.lit("a b").alias("raw")).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() > one.rdd.getNumPartitions() and spread(one).count() == 3000


def test_stopped_is_as_built_and_its_difference_moves_only_stopped_words(spark, index):
    built, view = SearchIndex.build(collection(spark, TEXTS), "none", ["the", "A"]), index.stopped(["the", "A"])
    assert view.params == built.params and view.diff(built).count() == 0
    d = index.diff(view)
    assert {(r.term, r.side) for r in d.select("term", "side").distinct().collect()} == {("the", "left"), ("a", "left")}
    assert d.count() == index.postings.where("term in ('the', 'a')").count() and view.diff(index).where("side = 'left'").count() == 0
    assert "exceptall" not in plan(d).lower()


def test_impacts_move_no_postings(index):
    i = build_impacts(index)
    assert "Exchange" not in plan(i.impacts) and i.impacts.count() == index.postings.count()
    want = index.postings.drop("weight").join(index.docs.select("docno", "weight"), "docno").count()
    assert index.postings.join(index.docs.select("docno", F.col("weight").alias("w")), "docno").where("weight = w").count() == want


@pytest.mark.parametrize("metric", [M.Dirichlet(), M.Okapi(), M.Cosine(), M.PivotedCosine(), M.AF1()])
def test_many_queries_score_as_each_alone(index, metric, monkeypatch):
    monkeypatch.setattr(B, "HELD", 100)
    queries = [(str(i), " ".join(random.choice(["the", "sea", "white", "whale", "ship", "x", "dont"]) for _ in range(1 + i % 4))) for i in range(12)]
    conjuncts = S.conjunct_rows(S.parse_all(index, queries))
    assert B.takes(conjuncts, metric)
    take = lambda df: sorted((r.qid, r.rank, r.docno, r.score) for r in df.collect())
    got, want = take(S.ranked(B.candidates(index, conjuncts, metric, 5), 0, 5)), take(S.ranked(S.scored(index, conjuncts, metric), 0, 5))
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-9)


def test_equal_scores_are_cut_by_docno():
    kept = B.best(np.array([1.0] * 50 + [2.0]), np.arange(51), 3)
    assert sorted(kept.tolist()) == [47, 48, 49, 50]


def test_a_stemmer_of_columns(spark):
    T.register_stemmer("first", lambda t: F.substring(t, 1, 1))
    i = SearchIndex.build(collection(spark, ["sea ship a", "", "the whale"]), "first", ["the"], keep_raw=False)
    assert {(r.term, r.df, r.cf) for r in i.vocab.collect()} == {("s", 1, 2), ("a", 1, 1), ("w", 1, 1)}
    assert {r.docno: (r.words, r.distinct_words, r.raw) for r in i.docs.collect()} == {0: (3, 2, ""), 1: (0, 0, ""), 2: (2, 2, "")}
