"""Topics, query lists, judgements and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlspark.functions.markup import lex

_LABEL = {"num": "number", "title": "topic", "desc": "description", "narr": "narrative"}
DUMMY = "XXXX-XXX-XXXXXXX"


def parse_topics(text: str, fields: tuple[str, ...] = ("title",), phrase: bool = False, slop: int = 0, cutoff: int = 0) -> list[tuple[str, str]]:
    """(number, query) of each <top> entry; a field's leading label word goes, the number is in upper case.

    With phrase the whole query is one phrase, with a sloppy and a cutoff modifier if they are given.
    """
    out: list[tuple[str, str]] = []
    number, words, now, first, inside = "", [], "", False, False
    for kind, value, _ in lex(text):
        if kind == "tag":
            if value == "top":
                number, words, now, inside = "", [], "", True
            elif value == "/top" and inside:
                if not number:
                    raise ValueError("a topic has no number")
                query = " ".join(words)
                if phrase and query:
                    query = f'"{query}"' + (f" [sloppy:{slop}]" if slop else "") + (f" [cutoff:{cutoff}]" if cutoff else "")
                out.append((number, query))
                inside = False
            else:
                now, first = value if value in _LABEL else "", True
        elif inside and now:
            label = first and value.lower().rstrip(":") == _LABEL[now]
            first = False
            if label:
                continue
            if now == "num":
                number = number or value.upper()
            elif now in fields:
                words.append(value)
    return out


def read_topics(spark: SparkSession, path: str, **options) -> DataFrame:
    """(qid, query) of a topic file."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # queries, not documents
    return spark.createDataFrame(parse_topics(text, **options), "qid string, query string")


def read_short_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of lines that hold a number, a space and a query."""
    parts = F.split(F.trim("value"), " ", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("qid"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("query"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of a file with one query a line; the qid is the line's number from 1."""
    lines = [r.value for r in spark.read.text(path).collect()]
    return spark.createDataFrame([(str(i + 1), q) for i, q in enumerate(lines)], "qid string, query string")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, rel) of lines `qid iter docno rel`; rel 1 unless its last character is 0."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("qid"), p[2].alias("docno"), (F.substring(p[3], -1, 1) != "0").cast("int").alias("rel"))


def run_lines(run: DataFrame, topics: DataFrame | None = None, runid: str = "trawl") -> DataFrame:
    """(value, qid, rank): tab-separated run lines; topics without results get a dummy line if topics are given."""
    line = _line(F.col("qid"), F.upper("aux"), F.col("rank").cast("string"), F.col("score"), runid)
    out = run.select(line.alias("value"), "qid", "rank")
    if topics is not None:
        empty = topics.join(run.select("qid").distinct(), "qid", "left_anti")
        out = out.union(empty.select(_line(F.col("qid"), F.lit(DUMMY), F.lit("1"), F.lit(0.0), runid).alias("value"), "qid", F.lit(1).alias("rank")))
    return out


def _line(qid: Column, doc: Column, rank: Column, score: Column, runid: str) -> Column:
    return F.concat_ws("\t", qid, F.lit("Q0"), doc, rank, F.format_string("%.6f", score.cast("double")), F.lit(runid))


def write_run(run: DataFrame, path: str, topics: DataFrame | None = None, runid: str = "trawl") -> None:
    lines = run_lines(run, topics, runid)
    lines.repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank").select("value").write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, rank, score, runid) of run lines."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("qid"), p[2].alias("docno"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("runid"))


def inherited_aux(docs: DataFrame) -> DataFrame:
    """docs with empty ids replaced by the last non-empty one before, within the same source."""
    own = Window.partitionBy("source").orderBy("docno").rowsBetween(Window.unboundedPreceding, 0)
    return docs.withColumn("aux", F.last(F.when(F.col("aux") != "", F.col("aux")), ignorenulls=True).over(own))
