from __future__ import annotations

from math import log, sqrt

import pytest
from pyspark.sql import functions as F
from trawlspark.operators import evaluate as E
from trawlspark.operators import metrics as M
from trawlspark.operators import search as S
from trawlspark.operators.conjuncts import sloppy_count
from trawlspark.operators.impacts import query_weights
from trawlspark.operators.index import Params, SearchIndex, with_docno
from trawlspark.operators.query import parse
from trawlspark.sources.documents import from_table
from trawlspark.sources.experiments import DUMMY, inherited_aux, parse_topics, read_qrels, read_queries, read_run, read_short_topics, read_topics, run_lines, write_run
from trawlspark.streaming.ingest import IndexWriter

TEXTS = ["the white whale", "a white whale and a white ship", "ship sea storm. whale", "the sea the sea", "a b a b c", "white ship", ""]


def collection(spark, texts, first=0):
    return from_table(spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "id long, t string"), "id", "t")


@pytest.fixture(scope="module")
def index(spark):
    return SearchIndex.build(collection(spark, TEXTS), "none", impacts=True)


KNOWN = set("white whale ship a b c d the and andy".split())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("white whale", "W(white) W(whale)"), ("whale Whale", "W(whale)*2"), ("white OR whale", "W(white) W(whale)"), ("white AND whale", "A(white,whale)"), ("a AND b AND c d", "A(a,b,c) W(d)"), ("a a AND b", "W(a) A(a,b)"),
        ("and", "W(and)"), ("ANDY", "W(andy)"), ("A b", "W(a) W(b)"), ('"white whale" ship', "P(white,whale) W(ship)"), ('"whale" whale', "W(whale)*2"), ('"a b" "a b"', "P(a,b)*2"), ('"a b" "a c"', "P(a,b) P(a,c)"),
        ('"white whale" [sloppy:3]', "P(white,whale)~3"), ('"white whale" [cutoff:100]', "P(white,whale)<100"), ("zzz whale", "W(whale)"), ("zzz AND whale", ""), ('"white zzz"', ""), ("-ship whale", "W(whale)"), ("a - b", "W(a) W(b)"),
        ("the whale", "W(whale)"), ("+the whale", "W(the) W(whale)"), ("the AND whale", "W(whale)"), ("whale AND the", "A(whale,the)"), ("(a OR b)", "W(a) W(b)"), ("[cache:12]", ""), ("", ""), ("... !", ""), ("a AND", "W(a) W(and)"), ("AND a", ""), ("a AND zzz", ""),
    ],
)
def test_query_language(query, want):
    p = parse(query, KNOWN.__contains__, stop={"the"})
    show = lambda c: f"{c.type[0]}({','.join(c.terms)})" + (f"*{c.f_qt}" if c.f_qt > 1 else "") + (f"~{c.slop}" if c.slop else "") + (f"<{c.cutoff}" if c.cutoff else "")
    got = " ".join(map(show, p.conjuncts))
    assert got == want or query == "AND a" and got in ("", "W(a)")
    if "cache" in query:
        assert p.cache == 12
    if "(" in query:
        assert "PARENS" in p.warnings


def test_word_limit():
    assert len(parse(" ".join("abcd"), KNOWN.__contains__, word_limit=3).conjuncts) == 3


def docs_of(index, query, **k):
    return {r.docno for r in S.search(index, query, length=100, **k).df.collect()}


def test_matching(index):
    assert docs_of(index, "white whale") == {0, 1, 2, 5}
    assert docs_of(index, "white AND whale") == {0, 1} and docs_of(index, '"white whale"') == {0, 1}
    assert docs_of(index, '"white ship"') == {1, 5} and docs_of(index, '"storm whale"') == set()  # another sentence
    assert docs_of(index, '"whale ship" [sloppy:4]') == {1} and docs_of(index, '"whale ship" [sloppy:5]') == {1, 2} and docs_of(index, '"white ship" [cutoff:3]') == {5}
    assert docs_of(index, "zzz") == set() and docs_of(index, "the sea", query_stop=["the"]) == {2, 3}
    r = S.search(index, "[cache:3]")
    assert r.df.first().summary == TEXTS[3]


def test_paging_is_a_slice(index):
    all_ = [r.docno for r in S.search(index, "white ship the", length=10).df.collect()]
    assert [r.docno for r in S.search(index, "white ship the", start=1, length=2).df.collect()] == all_[1:3]
    assert S.search(index, "white ship the", start=50).df.count() == 0 and S.search(index, "white ship the").total == len(all_)


def test_formulas(index):
    n, texts = len(TEXTS), [t.replace(".", "").split() for t in TEXTS]
    total, avg = sum(map(len, texts)), sum(map(len, texts)) / n
    df = sum("whale" in t for t in texts)
    w = {i: sqrt(sum((1 + log(t.count(x))) ** 2 for x in set(t))) for i, t in enumerate(texts)}
    idf = log((n - df + 0.5) / (df + 0.5))
    want = {
        M.Dirichlet(): lambda t, i: log(1 + t.count("whale") * total / (1500 * 3)) + log(1500 / (1500 + len(t))),
        M.Okapi(): lambda t, i: idf * 2.2 / (1.2 * (0.25 + 0.75 * len(t) / avg) + 1),
        M.Cosine(): lambda t, i: 1 / w[i],
        M.PivotedCosine(): lambda t, i: log(1 + n / df) / (0.8 + 0.2 * w[i] / (sum(w.values()) / n)),
        M.AF1(): lambda t, i: log(2) * idf,
    }
    for metric, f in want.items():
        for r in S.search(index, "whale", metric).df.collect():
            assert abs(r.score - f(texts[r.docno], r.docno)) < 1e-6
    the = S.search(SearchIndex.build(from_table(index.spark.createDataFrame([(i, "the") for i in range(3)], "id long, t string"), "id", "t"), "none"), "the", M.Okapi()).df.collect()
    assert [r.docno for r in the] == [2, 1, 0] and all(abs(r.score - M.FLT_EPSILON) < 1e-6 for r in the)


@pytest.mark.parametrize(("lists", "slop", "want"), [([[0, 2], [0, 2]], 0, [0, 2]), ([[1, 9], [3]], 2, [1]), ([[1], [9]], 3, []), ([[0, 5], [1, 6], [2, 7]], 2, [0, 5]), ([[], [1]], 3, [])])
def test_sloppy(lists, slop, want):
    assert len(sloppy_count(lists, slop)) == len(want)


def test_own_metric(index):
    class Count:
        needs_docs = False

        def contrib(self, p):
            return F.col("f_dt").cast("double")

        def post(self, score, p):
            return score

    assert {r.docno: r.score for r in S.search(index, "white ship", Count()).df.collect()} == {0: 1, 1: 3, 2: 1, 5: 2}


def test_impacts(index):
    i = index.impacts.collect()
    assert all(1 <= r.impact <= 33 for r in i) and len(i) == index.postings.count()
    assert docs_of(index, "white whale", metric=M.Impact()) == {0, 1, 2, 5}
    with pytest.raises(ValueError, match="words only"):
        S.search(index, '"white whale"', M.Impact())
    p = Params(avg_f_t=2, w_qt_min=0.1, w_qt_max=3.0)
    assert [t for t, _ in query_weights(p, [("x", 1, 1), ("y", 1, 2)])] == ["x", "y"]


def test_accumulator_limit(index):
    assert docs_of(index, "storm white", accumulator_limit=1) <= docs_of(index, "storm white")


def test_common_words_still_add_to_held_documents(index):
    scores = lambda **x: {r.docno: r.score for r in S.search(index, "storm whale", **x).df.collect()}
    whole, held = scores(), scores(accumulator_limit=1)
    assert set(whole) == {0, 1, 2} and held == {2: whole[2]}


def test_summaries(index):
    r = {r.docno: r.summary for r in S.search(index, "whale", summary="capitalise").df.collect()}
    assert r[2] == "ship sea storm.  WHALE" and r[0] == "the white WHALE"
    assert S.search(index, "whale", summary="tag").df.where("docno = 0").first().summary == "the white <b>whale</b>"
    lines = [x.value for x in S.result_lines(S.search(index, "storm").df).collect()]
    assert lines[0].startswith("1. 2 (score ") and lines[0].endswith("docid 2)")


def test_lookups(index, spark, tmp_path):
    assert index.term_info("white") == (3, 4, 5) and index.term_info("zzz") is None
    assert [(r.docno, r.f_dt) for r in index.term_postings("white", 1).collect()] == [(1, 2), (5, 1)]
    assert [r.term for r in index.vocab_iterator().limit(3).collect()] == ["a", "and", "b"]
    assert index.retrieve(0, 4, 5) == "white" and index.doc_aux(3) == "3" and index.doc_bytes(6) == 0 and index.retrieve(99) is None
    index.save(str(tmp_path / "i"))
    again = SearchIndex.load(spark, str(tmp_path / "i"))
    assert again.params == index.params and index.diff(again).count() == 0
    assert docs_of(again, "white whale") == docs_of(index, "white whale") and again.stats().first().N == 7
    assert SearchIndex.remove(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="no documents"):
        SearchIndex.build(collection(spark, TEXTS).limit(0))


def test_stopping_keeps_document_figures(spark, index):
    stopped = SearchIndex.build(collection(spark, TEXTS), "none", ["the"])
    assert stopped.term_info("the") is None and stopped.params.avg_words == index.params.avg_words and stopped.params.terms < index.params.terms


def test_adding_equals_building(spark, index):
    both = SearchIndex.build(collection(spark, TEXTS[:3]), "none").add(collection(spark, TEXTS[3:], 3))
    assert both.params.updates == 1 and both.params.N == 7 and both.params.terms == index.params.terms
    assert both.diff(index).count() == 0
    assert [r.docno for r in with_docno(collection(spark, ["x", "y"]), 5).orderBy("docno").collect()] == [5, 6]


def test_streaming(spark, tmp_path):
    for i in range(2):
        collection(spark, TEXTS[i * 3 : i * 3 + 3], i * 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    w = IndexWriter(None, str(tmp_path / "ix"), "none")
    s = spark.readStream.schema(collection(spark, TEXTS).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    w.start(s, str(tmp_path / "cp")).awaitTermination(120)
    assert w.commits == 2 and w.index.num_docs() == 6 and docs_of(w.index, "white whale") == {0, 1, 2, 5}


def test_ordering_laws(index):
    for a, b in (("white", "whale"), ("white", "ship"), ("sea", "the")):
        n_or, n_and, n_phrase = (len(docs_of(index, q)) for q in (f"{a} {b}", f"{a} AND {b}", f'"{a} {b}"'))
        assert n_or >= n_and >= n_phrase


def frame(spark, run, qrels):
    return spark.createDataFrame(run, "qid string, docno string, score double"), spark.createDataFrame(qrels, "qid string, docno string, rel int")


def test_evaluation(spark):
    run, rel = frame(spark, [("1", "a", 3.0), ("1", "b", 2.0), ("1", "c", 1.0), ("2", "x", 1.0)], [("1", "a", 1), ("1", "c", 2), ("1", "z", 0), ("2", "q", 1), ("3", "q", 1)])
    q = {r.qid: r for r in E.evaluate_queries(run, rel).collect()}
    assert abs(q["1"].ap - (1 + 2 / 3) / 2) < 1e-9 and q["1"].p5 == 0.4 and q["1"].r_prec == 0.5 and q["1"].i0 == 1.0 and abs(q["1"].i10 - 2 / 3) < 1e-9
    assert q["2"].ap == 0 and set(q) == {"1", "2"}
    e = E.evaluate(run, rel).first()
    assert e.queries == 2 and abs(e.ap - q["1"].ap / 2) < 1e-9 and "Retrieved:" in E.report(E.evaluate(run, rel))
    assert E.extras(run, rel).where("qid = '1'").first().recall5 == 1.0
    tie, rel = frame(spark, [("1", "a", 1.0), ("1", "b", 1.0)], [("1", "b", 1)])
    assert E.evaluate_queries(tie, rel).first().ap == 1.0  # equal scores: the higher id first


def test_wilcoxon(spark):
    assert [E.critical(n, 0.05) for n in (5, 6, 7, 8, 10, 20, 25)] == [-1, 0, 2, 3, 8, 52, 89] and E.critical(5, 0.1) == 0
    good, rel = frame(spark, [(str(q), d, s) for q in range(8) for d, s in (("r", 2.0), ("n", 1.0))], [(str(q), "r", 1) for q in range(8)])
    bad, _ = frame(spark, [(str(q), d, s) for q in range(8) for d, s in (("r", 1.0), ("n", 2.0))], [("1", "r", 1)])
    w = {r.measure: r for r in E.wilcoxon(bad, good, rel).collect()}
    assert w["ap"].improved == 8 and w["ap"].hypothesis == "rejected" and w["ap"].alpha == 0.05 and w["p5"].hypothesis == "no difference"
    assert {r.measure: r for r in E.wilcoxon(good, bad, rel).collect()}["ap"].degraded == 8


TOPICS = "<top>\n<num> Number: q1\n<title> Topic: White whale\n<desc> Description:\nFind it.\n<narr> Narrative: More.\n</top>\n<top><num>2<title>sea</top>"


def test_experiment_files(spark, tmp_path, index):
    assert parse_topics(TOPICS) == [("Q1", "White whale"), ("2", "sea")]
    assert parse_topics(TOPICS, ("title", "desc"), phrase=True, slop=2, cutoff=9)[0] == ("Q1", '"White whale Find it" [sloppy:2] [cutoff:9]')
    (tmp_path / "t").write_text(TOPICS)
    (tmp_path / "s").write_text("1 white whale\n2 sea\n\n")
    (tmp_path / "q").write_text("white\nsea storm\n")
    (tmp_path / "r").write_text("1 0 D1 1\n1 0 D2 0\n2 0 D3 10\n")
    assert [tuple(r) for r in read_topics(spark, str(tmp_path / "t")).collect()] == [("Q1", "White whale"), ("2", "sea")]
    assert [tuple(r) for r in read_short_topics(spark, str(tmp_path / "s")).collect()] == [("1", "white whale"), ("2", "sea")]
    assert [tuple(r) for r in read_queries(spark, str(tmp_path / "q")).collect()] == [("1", "white"), ("2", "sea storm")]
    assert [r.rel for r in read_qrels(spark, str(tmp_path / "r")).collect()] == [1, 0, 0]
    topics = spark.createDataFrame([("1", "white"), ("9", "zzz")], "qid string, query string")
    run = S.trec_run(index, [("1", "white"), ("9", "zzz")])
    lines = [r.value for r in run_lines(run, topics).collect()]
    assert any(x.startswith(f"9\tQ0\t{DUMMY}\t1\t0.000000") for x in lines) and len(lines) == 4
    write_run(run, str(tmp_path / "run"), topics)
    assert read_run(spark, str(tmp_path / "run")).where("qid = '1'").count() == 3
    docs = spark.createDataFrame([("f", 0, "A"), ("f", 1, ""), ("f", 2, "B")], "source string, docno long, aux string")
    assert [r.aux for r in inherited_aux(docs).orderBy("docno").collect()] == ["A", "A", "B"]
