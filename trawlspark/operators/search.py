"""Search: one query or a batch of them, ranked by a metric, paged, with summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlspark.functions.porter import porter
from trawlspark.functions.text import STEMMERS

from . import batch
from . import conjuncts as C
from .index import SearchIndex
from .metrics import METRICS, Dirichlet, Impact
from .query import WORD, Parsed, items, parse

AUX, TITLE, SUMMARY = 150, 50, 350


@dataclass
class SearchResults:
    """df(rank, docno, score, aux, title, summary); total counts all matches, exactly."""

    df: DataFrame
    total: int
    estimated: bool = False
    warnings: tuple[str, ...] = ()


def _stems(index: SearchIndex, words: set[str]) -> dict[str, str]:
    name = index.params.stemmer
    if name == "none":
        return {w: w for w in words}
    if name == "porters":
        return {w: porter(w) for w in words}
    if not words:
        return {}
    df = index.spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    return {r.w: r.s for r in df.select("w", STEMMERS[name](F.col("w")).alias("s")).collect()}


def parse_all(index: SearchIndex, queries: list[tuple[str, str]], query_stop: list[str] | None = None, word_limit: int | None = 20) -> dict[str, Parsed]:
    """The parsed queries; two small jobs stem their words and look them up, whatever their number."""
    stop = query_stop if query_stop is not None else index.query_stop or []
    words = {t for _, q in queries for i in items(q)[0] for t in i.terms}
    stems = _stems(index, words | {s.lower() for s in stop})
    wanted = sorted({stems[w] for w in words})
    known = {r.term for r in index.vocab.where(F.col("term").isin(wanted)).select("term").collect()} if wanted else set()
    stopped = {stems[s.lower()] for s in stop}
    return {qid: parse(q, known.__contains__, stems.__getitem__, stopped, word_limit) for qid, q in queries}


def conjunct_rows(parsed: dict[str, Parsed]) -> list[tuple]:
    return [(qid, i, c.type, list(c.terms), c.f_qt, c.slop, c.cutoff) for qid, p in parsed.items() for i, c in enumerate(p.conjuncts)]


def weighted_lists(index: SearchIndex, rows: list[tuple]) -> DataFrame:
    """(qid, cid, docno, f_dt, f_qt, df, cf) of all conjuncts: words' df and cf from the vocabulary, others' from their own lists."""
    spark = index.spark
    conj = spark.createDataFrame(rows, C.SCHEMA)
    plain = [r for r in rows if r[2] == WORD and not r[6]]
    rest = [r for r in rows if not (r[2] == WORD and not r[6])]
    out = []
    if plain:
        q = spark.createDataFrame([(r[0], r[1], r[3][0], r[4]) for r in plain], "qid string, cid int, term string, f_qt int")
        q = q.join(index.vocab.where(F.col("term").isin(sorted({r[3][0] for r in plain}))).select("term", "df", "cf"), "term")
        # the terms as a literal list reach the scan, where the sorted postings' statistics skip what can't match
        p = index.postings.where(F.col("term").isin(sorted({r[3][0] for r in plain})))
        out.append(p.join(F.broadcast(q), "term").select("qid", "cid", "docno", "f_dt", "f_qt", "df", "cf"))
    if rest:
        kinds = {(r[2], r[5] > 0, r[6] > 0) for r in rest}
        p = index.postings.where(F.col("term").isin(sorted({t for r in rest for t in r[3]})))
        if len(plain) != len(rows):
            conj = spark.createDataFrame(rest, C.SCHEMA)
        found = C.lists(p, conj, kinds)
        own = found.groupBy("qid", "cid").agg(F.count("*").alias("df"), F.sum("f_dt").cast("long").alias("cf"))
        own = own.join(F.broadcast(conj.select("qid", "cid", "f_qt")), ["qid", "cid"])
        out.append(found.join(F.broadcast(own), ["qid", "cid"]).select("qid", "cid", "docno", "f_dt", "f_qt", "df", "cf"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def scored(index: SearchIndex, rows: list[tuple], metric) -> DataFrame:
    """(qid, docno, score) of every matching document."""
    if isinstance(metric, Impact):
        from .impacts import impact_scores

        return impact_scores(index, rows)
    if not rows:
        return index.spark.createDataFrame([], "qid string, docno long, score double")
    p = index.params
    lists = weighted_lists(index, rows)
    from math import log, sqrt

    by: dict[str, list[int]] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[4])
    q = index.spark.createDataFrame([(k, float(sum(v)), sqrt(sum((1 + log(x)) ** 2 for x in v))) for k, v in by.items()], "qid string, q_terms double, q_weight double")
    docs = index.docs.select("docno", "words", "weight")
    words_in_contrib = "words" in metric.contrib(p)._jc.toString()
    if metric.needs_docs and words_in_contrib:
        lists = lists.join(docs, "docno")
    sums = lists.withColumn("c", metric.contrib(p)).groupBy("qid", "docno").agg(F.sum("c").alias("score"))
    if metric.needs_docs and not words_in_contrib:
        sums = sums.join(docs, "docno")
        sums = sums.join(F.broadcast(q), "qid").withColumn("score", metric.post(F.col("score"), p))
    return sums.select("qid", "docno", "score")


def ranked(scores: DataFrame, start: int = 0, length: int = 20, digits: int | None = 9) -> DataFrame:
    """(qid, rank, docno, score): by score, then higher document first. Sums differ in their last digits, so ranking takes `digits`."""
    s = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    own = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docno"))
    return s.withColumn("rank", F.row_number().over(own)).where((F.col("rank") > start) & (F.col("rank") <= start + length))


def batch_search(index: SearchIndex, queries: list[tuple[str, str]], metric=None, length: int = 1000, start: int = 0, query_stop: list[str] | None = None, word_limit: int | None = 20) -> DataFrame:
    """(qid, rank, docno, score, aux) of all queries in one job."""
    metric = Dirichlet() if metric is None else METRICS[metric]() if isinstance(metric, str) else metric
    rows = conjunct_rows(parse_all(index, queries, query_stop, word_limit))
    scores = batch.candidates(index, rows, metric, start + length) if batch.takes(rows, metric) else scored(index, rows, metric)
    top = ranked(scores, start, length)
    return top.join(index.docs.select("docno", "aux"), "docno").select("qid", "rank", "docno", "score", "aux")


def search(index: SearchIndex, query: str, metric=None, start: int = 0, length: int = 20, summary: str = "none", query_stop: list[str] | None = None, word_limit: int | None = 20, accumulator_limit: int | None = None) -> SearchResults:
    """The best documents for a query. summary: none, plain, tag or capitalise.

    [cache:n] fetches document n instead. accumulator_limit keeps that many documents of the rarest
    words' lists and lets further words only add to them, as a bounded-memory engine would; by default
    every document counts.
    """
    metric = Dirichlet() if metric is None else METRICS[metric]() if isinstance(metric, str) else metric
    parsed = parse_all(index, [("1", query)], query_stop, word_limit)
    one = parsed["1"]
    if one.cache is not None:
        df = index.docs.where(F.col("docno") == one.cache).select(F.lit(1).alias("rank"), "docno", F.lit(0.0).alias("score"), F.substring("aux", 1, AUX).alias("aux"), F.substring("title", 1, TITLE).alias("title"), F.col("raw").alias("summary"))
        return SearchResults(df, df.count(), warnings=tuple(one.warnings))
    rows = conjunct_rows(parsed)
    scores = scored(index, [r for r in rows if r[0] == "1"], metric)
    if accumulator_limit is not None and len(rows) > 1:
        held = scored(index, _limited(index, rows, accumulator_limit), metric)
        scores = scores.join(held.select("docno").distinct(), "docno", "left_semi")
    total = scores.count()
    s = scores.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), F.desc("docno")).offset(start).limit(length)
    own = Window.orderBy(F.desc("score"), F.desc("docno"))  # of one page
    top = s.withColumn("rank", F.row_number().over(own) + start)
    top = top.join(index.docs, "docno").select("rank", "docno", "score", F.substring("aux", 1, AUX).alias("aux"), F.substring("title", 1, TITLE).alias("title"), "type", "raw")
    if summary != "none":
        from .summary import summarised

        top = summarised(top, rows, index.params.stemmer, summary)
    else:
        top = top.withColumn("summary", F.lit(""))
    return SearchResults(top.select("rank", "docno", "score", "aux", "title", "summary").orderBy("rank"), total, warnings=tuple(one.warnings))


def _limited(index: SearchIndex, rows: list[tuple], limit: int) -> list[tuple]:
    """The lists, rarest words first, whose documents fill the limit; at least one."""
    df = {r.term: r.df for r in index.vocab.where(F.col("term").isin(sorted({t for r in rows for t in r[3]}))).select("term", "df").collect()}
    order = sorted(rows, key=lambda r: min(df.get(t, 0) for t in r[3]))
    kept, held = [], 0
    for r in order:
        if kept and held >= limit:
            break
        kept.append(r)
        held += min(df.get(t, 0) for t in r[3])
    return kept


def result_lines(results: DataFrame) -> DataFrame:
    """(value, rank): `rank. id (score s, docid d)` and the title and summary behind it."""
    line = F.format_string("%d. %s (score %.6f, docid %d)", F.col("rank"), F.col("aux"), F.col("score").cast("double"), F.col("docno"))
    more = F.when(F.concat("title", "summary") != "", F.concat(F.lit("\n"), F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("summary", F.lit(""))))).otherwise("")
    return results.select(F.concat(line, more).alias("value"), "rank")


def footer(results: SearchResults, shown: int) -> str:
    return f"{results.total} results of {'about ' if results.estimated else ''}{results.total} shown" if shown == results.total else f"{shown} results of {'about ' if results.estimated else ''}{results.total} shown"


def trec_run(index: SearchIndex, topics: list[tuple[str, str]], metric=None, n: int = 1000, query_stop: list[str] | None = None) -> DataFrame:
    """Results of all topics, without a limit on a topic's words."""
    return batch_search(index, topics, metric, n, query_stop=query_stop, word_limit=None)
