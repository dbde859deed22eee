"""Registered queries of the search engine, each over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlspark.functions import mime
from trawlspark.functions import text as T
from trawlspark.functions.markup import extract_words
from trawlspark.functions.stop import DEFAULT
from trawlspark.operators import evaluate as E
from trawlspark.operators import search as S
from trawlspark.operators.impacts import build_impacts
from trawlspark.operators.index import SearchIndex, parsed
from trawlspark.operators.metrics import AF1, Cosine, Dirichlet, Impact, Okapi, PivotedCosine
from trawlspark.plans.session import ship, workspace
from trawlspark.sources.documents import from_table
from trawlspark.sources.experiments import run_lines

_open: dict[tuple, SearchIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "documents"), "doc_id", "text", source="source")


def index(spark: SparkSession, sf_dir: str, stemmer: str = "none", stop: tuple[str, ...] | None = None, impacts: bool = False) -> SearchIndex:
    """The index of documents, built once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, stemmer, stop, impacts)
    if key not in _open:
        if impacts:
            _open[key] = build_impacts(index(spark, sf_dir, stemmer, stop))
        elif stop and (key[:3] + (None, False)) in _open:
            _open[key] = index(spark, sf_dir, stemmer).stopped(list(stop))
        else:
            _open[key] = SearchIndex.build(documents(spark, sf_dir), stemmer, list(stop) if stop else None)
    return _open[key]


OR_QUERY, AND_QUERY, PHRASE_QUERY = "the und que the", "the AND and de", '"of the" and'
STOP = ("the", "der", "de", "la")


def _found(results: DataFrame) -> DataFrame:
    return results.select("qid", F.col("rank").cast("long").alias("rank"), "docno", F.round("score", 6).alias("score"))


def _search(query: str, metric=None, start: int = 0, length: int = 20, stemmer: str = "none", stop: tuple[str, ...] | None = None, query_stop: list[str] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(S.batch_search(index(spark, sf_dir, stemmer, stop), [("1", query)], metric, length, start, query_stop))

    return run


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index(spark, sf_dir).stats()
    return s.select(F.col("N").alias("n_docs"), F.col("terms").alias("n_terms"), F.col("distinct").alias("n_distinct"), F.round("avg_words", 6).alias("avg_words"), F.round("avg_distinct", 6).alias("avg_distinct"), F.round("avg_weight", 6).alias("avg_weight"), F.round("avg_bytes", 6).alias("avg_bytes"), "avg_f_t")


def docmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).docs.select("docno", "aux", "bytes", F.col("words").cast("long").alias("words"), F.col("distinct_words").cast("long").alias("distinct_words"), F.round("weight", 6).alias("weight"))


def vocabulary(stemmer: str = "none", stop: tuple[str, ...] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index(spark, sf_dir, stemmer, stop).vocab.select("term", "df", "cf", F.col("last").alias("last_doc"))

    return run


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = index(spark, sf_dir).postings
    return p.select("term", "docno", F.col("f_dt").cast("long").alias("f_dt"), F.array_join(F.col("offsets").cast("array<string>"), " ").alias("offsets"))


def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = index(spark, sf_dir).term_postings("the", 100)
    return p.select("docno", F.col("f_dt").cast("long").alias("f_dt"), F.array_join(F.col("offsets").cast("array<string>"), " ").alias("offsets"))


def total_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index(spark, sf_dir)
    out = None
    for k, q in enumerate((OR_QUERY, AND_QUERY, PHRASE_QUERY)):
        rows = S.conjunct_rows(S.parse_all(i, [(str(k), q)]))
        one = S.scored(i, rows, Dirichlet()).agg(F.count("*").alias("total")).select(F.lit(str(k)).alias("qid"), "total")
        out = one if out is None else out.union(one)
    return out


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text").collect()  # the query set
    return [(str(r.item_id), " ".join(extract_words(r.text or ""))) for r in rows]


def batch(metric):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = index(spark, sf_dir)
        return _found(S.trec_run(i, _benchmark_queries(spark, sf_dir), metric, 10))

    return run


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements for the four languages as queries: good documents of the language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("lang is not null")
    return d.select(F.col("lang").alias("qid"), F.col("doc_id").cast("string").alias("docno"), F.col("quality").alias("rel"))


LANGUAGE_QUERIES = [("en", "the and"), ("de", "der und"), ("fr", "le que"), ("es", "el que")]


def _language_run(spark: SparkSession, sf_dir: str, metric=None) -> DataFrame:
    r = S.trec_run(index(spark, sf_dir), LANGUAGE_QUERIES, metric or Dirichlet(), 1000)
    return r.select("qid", F.col("docno").cast("string").alias("docno"), "score")


def evaluation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.evaluate_queries(_language_run(spark, sf_dir), _qrels(spark, sf_dir))
    return e.select("qid", "retrieved", F.col("relevant").cast("long").alias("relevant"), F.col("rel_ret").cast("long").alias("rel_ret"), *(F.round(c, 6).alias(c) for c in ("ap", "p5", "p10", "p100", "r_prec", "i0", "i3", "i10")))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.evaluate(_language_run(spark, sf_dir), _qrels(spark, sf_dir))
    return e.select("queries", *(F.round(c, 6).alias(c) for c in ("ap", "p10", "r_prec")))


def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.wilcoxon(_language_run(spark, sf_dir), _language_run(spark, sf_dir, Okapi()), _qrels(spark, sf_dir))


def run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.trec_run(index(spark, sf_dir), LANGUAGE_QUERIES, Dirichlet(), 10)
    topics = spark.createDataFrame([*LANGUAGE_QUERIES, ("none", "zzzzqq")], "qid string, query string")
    return run_lines(r, topics).select(F.col("value").alias("line"))


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, impacts=True).impacts.select("term", "docno", F.col("impact").cast("long").alias("impact"))


def impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(S.batch_search(index(spark, sf_dir, impacts=True), [("1", "the und que")], Impact(), 20))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(index(spark, sf_dir, "light"), "the and", summary="capitalise", length=10).df


def result_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.result_lines(S.search(index(spark, sf_dir), OR_QUERY).df).select(F.col("value").alias("line"), "rank")


def cache_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(index(spark, sf_dir), "[cache:12]").df.select("docno", F.col("summary").alias("text"))


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after the conversations' turns were added to the documents."""
    c = table(spark, sf_dir, "conversations")
    new = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("docno"), F.concat_ws(":", "conv_id", "turn").alias("aux"), F.lit(None).cast("string").alias("source"), F.lit(mime.HTML).alias("type"), F.coalesce("text", F.lit("")).alias("raw"))
    return index(spark, sf_dir).add(new).vocab.select("term", "df", "cf")


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = index(spark, sf_dir).diff(index(spark, sf_dir, "none", STOP))
    return d.groupBy("term", "side").agg(F.count("*").alias("n"))


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    both = p.select(F.lit("pages").alias("source"), F.col("html").alias("c")).union(d.select(F.lit("documents").alias("source"), F.col("text").alias("c")))
    return both.select("source", mime.guess(F.col("c")).alias("type")).groupBy("source", "type").agg(F.count("*").alias("n"))


def pages_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and numbers of indexed words of the pages, after the tag rules."""
    p = parsed(from_table(table(spark, sf_dir, "pages"), "page_id", "html", aux="url"))
    return p.select("docno", "title", "words")


def pages_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "pages")
    if key not in _open:
        _open[key] = SearchIndex.build(from_table(table(spark, sf_dir, "pages"), "page_id", "html", aux="url"), "light")
    return S.search(_open[key], "the track0", summary="tag").df


def string_functions_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    x = F.concat(F.lit("  "), F.col("text"), F.lit("\t "))
    url = F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", T.strip_word(x).alias("stripped"), T.ltrim(x).alias("left_trimmed"), T.rtrim(x).alias("right_trimmed"), T.dirname(url).alias("dir"), T.basename(url).alias("base"))


def stems(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = index(spark, sf_dir).vocab.select("term")
        return v.select("term", T.STEMMERS[name](F.col("term")).alias("stem"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "collection_stats": collection_stats,
    "docmap": docmap,
    "vocabulary": vocabulary(),
    "vocabulary_light": vocabulary("light"),
    "vocabulary_porter": vocabulary("porters"),
    "vocabulary_stopped": vocabulary("none", STOP),
    "postings": postings,
    "term_postings": term_postings,
    "stem_eds": stems("eds"),
    "stem_light": stems("light"),
    "stem_porter": stems("porters"),
    "search_dirichlet": _search(OR_QUERY, Dirichlet()),
    "search_okapi": _search(OR_QUERY, Okapi()),
    "search_cosine": _search(OR_QUERY, Cosine()),
    "search_pcosine": _search(OR_QUERY, PivotedCosine()),
    "search_af1": _search(OR_QUERY, AF1()),
    "search_and": _search(AND_QUERY),
    "search_phrase": _search(PHRASE_QUERY),
    "search_phrase_okapi": _search('"of the"', Okapi()),
    "search_sloppy": _search('"the of" [sloppy:3]'),
    "search_cutoff": _search('"of the" [cutoff:20]'),
    "search_word_cutoff": _search("the [cutoff:5]"),
    "search_page": _search(OR_QUERY, start=20, length=15),
    "search_query_stop": _search("the und +que", query_stop=list(DEFAULT)),
    "search_build_stop": _search("the und que", stop=STOP),
    "search_unknown_and": _search("zzzzqq AND the und"),
    "total_results": total_results,
    "batch_dirichlet": batch(Dirichlet()),
    "batch_okapi": batch(Okapi()),
    "evaluation_queries": evaluation_queries,
    "evaluation": evaluation,
    "wilcoxon": wilcoxon,
    "run_file": run_file,
    "impacts": impacts,
    "impact_search": impact_search,
    "summaries": summaries,
    "result_print": result_print,
    "cache_fetch": cache_fetch,
    "added": added,
    "index_diff": index_diff,
    "content_types": content_types,
    "pages_parsed": pages_parsed,
    "pages_search": pages_search,
    "string_functions_whole": string_functions_whole,
}

# DuckDB

_W = r"[ \t\n\x0b\f\r]"
_FULL = rf"(?:{T.TOKEN})(?:(?:[.!?]?{T._PUNCT})?[.!?]{_W})?"
_q = lambda s: s.replace("'", "''")


def _index_sql(source: str = "select doc_id as docno, coalesce(text, '') as raw from documents", stem: str = "term", stop: tuple[str, ...] = ()) -> str:
    """CTEs raw, occ, allpost, docs, post, vocab, n."""
    out = f"where term not in ({', '.join(repr(s) for s in stop)})" if stop else ""
    return rf"""
raw as ({source}),
m as (select docno, regexp_extract_all(regexp_replace(raw, '{_q(T.JUNK)}', '', 'g') || ' ', '{_q(_FULL)}', 0) as m from raw),
f as (select docno, unnest(m) as f, generate_subscripts(m, 1) - 1 as i from m),
w as (select docno, i, lower(regexp_replace(f, '[^A-Za-z0-9]', '', 'g')) as term, regexp_matches(f, '{_W}$') and not regexp_full_match(f, '(?:[A-Z]\.)+{_W}') as e from f),
p as (select docno, term, i + coalesce(sum((e and length(term) <= 49)::int) over (partition by docno order by i rows between unbounded preceding and 1 preceding), 0) as pos from w),
occ as (select docno, {stem} as term, pos from p where length(term) <= 49),
allpost as (select term, docno, count(*) as f_dt, list(pos::bigint order by pos) as offsets from occ group by term, docno),
docs as (select raw.docno, strlen(any_value(raw)) as bytes, coalesce(sum(f_dt), 0)::bigint as words, count(f_dt) as distinct_words, coalesce(sqrt(sum((1 + ln(f_dt)) * (1 + ln(f_dt)))), 0) as weight from raw left join allpost using (docno) group by raw.docno),
post as (select * from allpost {out}),
vocab as (select term, count(*) as df, sum(f_dt)::bigint as cf, max(docno) as last from post group by term),
n as (select count(*)::double as N, avg(words) as avg_words, avg(weight) as avg_weight, (select sum(cf)::double from vocab) as T from docs)"""


_PARTS = {
    "dirichlet": ("ln(1 + f_dt * T / (1500.0 * cf))", "+ q_terms * ln(1500.0 / (1500.0 + words))"),
    "okapi": ("((1e10 + 1) * f_qt / (1e10 + f_qt)) * (case when ln((N - df + 0.5) / (df + 0.5)) <= 0 then 1.1920929e-07 else ln((N - df + 0.5) / (df + 0.5)) end) * 2.2 * f_dt / (1.2 * (0.25 + 0.75 * words / avg_words) + f_dt)", ""),
    "cosine": ("(1 + ln(f_qt)) * (1 + ln(f_dt))", "/ (weight * q_weight)"),
    "pcosine": ("f_qt * ln(1 + N / df) * (1 + ln(f_dt))", "/ (0.8 + 0.2 * weight / avg_weight)"),
    "af1": ("((1e10 + 1) * f_qt / (1e10 + f_qt)) * ln(f_dt + 1) * ln((N - df + 0.5) / (df + 0.5))", ""),
}


def _rank_sql(lists: str, queries: str, metric: str, start: int = 0, length: int = 20) -> str:
    """CTEs list(qid, cid, docno, f_dt, df, cf, f_qt) given; queries: CTE qn(qid, q_terms, q_weight)."""
    contrib, post = _PARTS[metric]
    return rf"""{lists}, {queries},
s as (select qid, docno, sum({contrib}) as s from list join docs using (docno) cross join n group by qid, docno),
r as (select qid, docno, round(s {post}, 9) as score from s join docs using (docno) join qn using (qid) cross join n),
k as (select *, row_number() over (partition by qid order by score desc, docno desc) as rank from r)
select qid, rank, docno, round(score, 6) as score from k where rank > {start} and rank <= {start + length}"""


def _words_cte(terms: dict[str, int]) -> str:
    values = ", ".join(f"('1', {i}, '{t}', {f})" for i, (t, f) in enumerate(terms.items()))
    return f"qw(qid, cid, term, f_qt) as (values {values}),\nwl as (select qid, cid, docno, f_dt, df, cf, f_qt from qw join vocab using (term) join post using (term))"


def _qn(*f: int) -> str:
    from math import log, sqrt

    return f"qn(qid, q_terms, q_weight) as (values ('1', {sum(f)}, {sqrt(sum((1 + log(x)) ** 2 for x in f))!r}))"


def _or_sql(metric: str, terms: dict[str, int], start: int = 0, length: int = 20, stop: tuple[str, ...] = (), stem: str = "term") -> str:
    return f"with {_index_sql(stem=stem, stop=stop)},\n" + _rank_sql(_words_cte(terms) + ", list as (select * from wl)", _qn(*terms.values()), metric, start, length)


def _phrase_cte(cid: int, terms: list[str], where: str = "true") -> str:
    union = " union all ".join(f"select docno, {i} as i, unnest(offsets) + {len(terms) - 1 - i} as e from post where term = '{t}'" for i, t in enumerate(terms))
    return f"""pe{cid} as (select docno, e from ({union}) group by docno, e having count(*) = {len(terms)}),
pl{cid} as (select docno, count(*) as f_dt, min(e) as first from pe{cid} group by docno having {where}),
p{cid} as (select '1' as qid, {cid} as cid, docno, f_dt, (select count(*) from pl{cid}) as df, (select sum(f_dt) from pl{cid}) as cf, 1 as f_qt from pl{cid})"""


def _and_cte(cid: int, terms: list[str]) -> str:
    return f"""al{cid} as (select docno, min(f_dt) as f_dt from post where term in ({', '.join(map(repr, terms))}) group by docno having count(*) = {len(terms)}),
a{cid} as (select '1' as qid, {cid} as cid, docno, f_dt, (select count(*) from al{cid}) as df, (select sum(f_dt) from al{cid}) as cf, 1 as f_qt from al{cid})"""


_LIGHT = r"case when regexp_matches(term, '^..+?(?:ies|ied)$') or regexp_matches(term, '^..(?:ies|ied)$') then regexp_replace(term, '^(..+?|..)(?:ies|ied)$', '\1y') when regexp_matches(term, '^..+ie$') then term else regexp_replace(term, '^(..+?)(?:ingly|ing|ly|ed|es|e|s)$', '\1') end"
_OR3, _OR4 = {"the": 1, "und": 1, "que": 1}, {"the": 2, "und": 1, "que": 1}
_I = f"with {_index_sql()}"

_BATCH = r"""qt as (select item_id::varchar as qid, term, count(*) as f_qt from (select item_id, lower(regexp_replace(unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '{junk}', '', 'g'), '{token}', 0)), '[^A-Za-z0-9]', '', 'g')) as term from benchmark) where length(term) <= 49 group by all),
list as (select qid, 0 as cid, docno, f_dt, df, cf, f_qt from qt join vocab using (term) join post using (term))""".format(junk=_q(T.JUNK), token=_q(T.TOKEN))
_BATCH_QN = "qn as (select qid, sum(f_qt) as q_terms, sqrt(sum((1 + ln(f_qt)) * (1 + ln(f_qt)))) as q_weight from qt join vocab using (term) group by qid)"

_EVAL = rf"""with {_index_sql()},
lq(qid, term) as (values {', '.join(f"('{q}', '{t}')" for q, x in LANGUAGE_QUERIES for t in x.split())}),
s as (select qid, docno, sum(ln(1 + f_dt * T / (1500.0 * cf))) as s from lq join vocab using (term) join post using (term) cross join n group by all),
sc as (select qid, s.docno, round(s + (select count(*) from lq join vocab using (term) where lq.qid = s.qid) * ln(1500.0 / (1500.0 + words)), 9) as score from s join docs using (docno)),
run as (select * from (select *, row_number() over (partition by qid order by score desc, docno desc) as k from sc) where k <= 1000),
rel as (select lang as qid, doc_id::varchar as docno, max(quality) as rel from documents join labels using (doc_id) where lang is not null group by all),
nrel as (select qid, count(*) as relevant from rel where rel <> 0 group by qid),
r as (select run.qid, run.docno, row_number() over (partition by run.qid order by score desc, run.docno::varchar desc) as rank, coalesce((rel <> 0)::int, 0) as rel from run left join rel on rel.qid = run.qid and rel.docno = run.docno::varchar),
h as (select *, sum(rel) over (partition by qid order by rank rows unbounded preceding) as hits from r),
b as (select *, max(case when rel = 1 then hits / rank::double else 0 end) over (partition by qid order by rank rows between 0 preceding and unbounded following) as best from h),
e as (select b.qid, count(*) as retrieved, coalesce(any_value(relevant), 0)::bigint as relevant, sum(rel)::bigint as rel_ret,
  sum(case when rel = 1 then hits / rank::double else 0 end) / any_value(relevant) as ap, sum(rel) filter (rank <= 5) / 5.0 as p5, sum(rel) filter (rank <= 10) / 10.0 as p10, sum(rel) filter (rank <= 100) / 100.0 as p100,
  coalesce(sum(rel) filter (rank <= relevant), 0) / any_value(relevant)::double as r_prec, {', '.join(f"coalesce(max(best) filter (rel = 1 and hits >= greatest(1, ceil(relevant * {i} / 10.0))), 0) as i{i}" for i in (0, 3, 10))}
  from b left join nrel using (qid) group by b.qid)"""
_IMPACT = r""", j as (select term, docno, (1 + ln(f_dt)) / (0.8 + 0.2 * weight / avg_weight) as x from post join docs using (docno) cross join n),
l as (select min(x) as lo, max(x) as hi from j),
v as (select term, docno, lo, hi, greatest(lo, least(hi, lo + lo * log10(x / lo) / log10(pow(hi / lo, lo / (hi - lo))))) as y from j cross join l)
select term, docno, (floor(32 * (y - lo) / (hi - lo + 0.0001)) + 1)::bigint as impact from v"""

ORACLES: dict[str, str] = {
    "collection_stats": f"{_I} select N::bigint as n_docs, T::bigint as n_terms, (select count(*) from vocab) as n_distinct, round(avg_words, 6) as avg_words, (select round(avg(distinct_words), 6) from docs) as avg_distinct, round(avg_weight, 6) as avg_weight, (select round(avg(bytes), 6) from docs) as avg_bytes, (select (sum(df) // count(*))::bigint from vocab) as avg_f_t from n",
    "docmap": f"{_I} select docno, docno::varchar as aux, bytes, words, distinct_words, round(weight, 6) as weight from docs",
    "vocabulary": f"{_I} select term, df, cf, last as last_doc from vocab",
    "vocabulary_light": f"with {_index_sql(stem=_LIGHT)} select term, df, cf, last as last_doc from vocab",
    "vocabulary_stopped": f"with {_index_sql(stop=STOP)} select term, df, cf, last as last_doc from vocab",
    "postings": f"{_I} select term, docno, f_dt, array_to_string(offsets, ' ') as offsets from post",
    "term_postings": f"{_I} select docno, f_dt, array_to_string(offsets, ' ') as offsets from post where term = 'the' and docno >= 100",
    "stem_eds": rf"{_I} select term, regexp_replace(term, '^(..+?)(?:ed|e|s)$', '\1') as stem from vocab",
    "stem_light": f"{_I} select term, {_LIGHT} as stem from vocab",
    **{f"search_{m}": _or_sql(m, _OR4) for m in _PARTS},
    "search_and": f"{_I},\n" + _rank_sql(_and_cte(0, ["the", "and"]) + ",\n" + _words_cte({"de": 1}) + ", list as (select * from a0 union all by name select * from wl)", _qn(1, 1), "dirichlet"),
    "search_phrase": f"{_I},\n" + _rank_sql(_phrase_cte(0, ["of", "the"]) + ",\n" + _words_cte({"and": 1}) + ", list as (select * from p0 union all by name select * from wl)", _qn(1, 1), "dirichlet"),
    "search_phrase_okapi": f"{_I},\n" + _rank_sql(_phrase_cte(0, ["of", "the"]) + ", list as (select * from p0)", _qn(1), "okapi"),
    "search_cutoff": f"{_I},\n" + _rank_sql(_phrase_cte(0, ["of", "the"], "min(e) < 20") + ", list as (select * from p0)", _qn(1), "dirichlet"),
    "search_word_cutoff": f"{_I},\n" + _rank_sql(_phrase_cte(0, ["the"], "min(e) < 5") + ", list as (select * from p0)", _qn(1), "dirichlet"),
    "search_page": _or_sql("dirichlet", _OR4, 20, 15),
    "search_query_stop": _or_sql("dirichlet", {"und": 1, "que": 1}),
    "search_build_stop": _or_sql("dirichlet", {"und": 1, "que": 1}, stop=STOP),
    "search_unknown_and": _or_sql("dirichlet", {"und": 1}),
    "total_results": f"{_I}, {_phrase_cte(1, ['of', 'the'])}, {_and_cte(1, ['the', 'and'])} select '0' as qid, count(distinct docno) as total from post where term in ('the', 'und', 'que') union all select '1', count(*) from (select docno from al1 union select docno from post where term = 'de') union all select '2', count(*) from (select docno from pl1 union select docno from post where term = 'and')",
    "batch_dirichlet": f"{_I},\n" + _rank_sql(_BATCH, _BATCH_QN, "dirichlet", 0, 10),
    "batch_okapi": f"{_I},\n" + _rank_sql(_BATCH, _BATCH_QN, "okapi", 0, 10),
    "evaluation_queries": _EVAL + " select qid, retrieved, relevant, rel_ret, " + ", ".join(f"round({c}, 6) as {c}" for c in ("ap", "p5", "p10", "p100", "r_prec", "i0", "i3", "i10")) + " from e",
    "evaluation": _EVAL + " select count(*) as queries, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in ("ap", "p10", "r_prec")) + " from e",
    "impacts": _I + _IMPACT,
    "cache_fetch": "select doc_id as docno, text from documents where doc_id = 12",
    "added": "with " + _index_sql("select doc_id as docno, coalesce(text, '') as raw from documents union all select -1 - (conv_id * 100000 + turn), coalesce(text, '') from conversations") + " select term, df, cf from vocab",
    "index_diff": f"{_I} select term, 'left' as side, count(*) as n from post where term in ({', '.join(map(repr, STOP))}) group by term",
    "content_types": r"select source, case when regexp_matches(c, '^[\x09-\x0d ]*(?i:<doc>)') then 'application/x-trec' when regexp_matches(c, '^[\x09-\x0d ]*(?i:<article>)') then 'application/x-inex' when regexp_matches(c, '^[\x09-\x0d ]*(?i:<!doctype html|<head|<title|<html)') then 'text/html' when starts_with(c, '%!') then 'application/postscript' else 'application/octet-stream' end as type, count(*) as n from (select 'pages' as source, html as c from pages union all select 'documents', text from documents) group by all",
    "string_functions_whole": r"with x as (select doc_id, '  ' || text || chr(9) || ' ' as x, '/data/' || source || '/' || doc_id as u from documents) select doc_id, lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) as stripped, regexp_replace(x, '^[ \t\n\x0b\f\r]+', '') as left_trimmed, regexp_replace(x, '[ \t\n\x0b\f\r]+$', '') as right_trimmed, regexp_replace(u, '/[^/]*$', '') as dir, regexp_extract(u, '[^/]*$') as base from x",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of queries ranked by the default metric."""
    return S.batch_search(index(spark, sf_dir), [*LANGUAGE_QUERIES, ("all", OR_QUERY), ("phrase", PHRASE_QUERY), ("and", AND_QUERY)], length=20)


__all__ = ["ORACLES", "QUERIES", "flagship", "workspace"]
