"""Quality rules, native: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Word unigrams and bigrams fall into BUCKETS hash buckets. Two multinomials over the buckets are
counted: one over a trusted target (documents that labels call good), one over all documents. A
document's verdict is the mean log ratio of its n-grams against a fixed threshold, so every document
is decided by itself and alike on every run. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Pseudo-count of each bucket, in counts of the target.
SMOOTH = 64.0
#: Kept from this mean natural-log ratio on.
THRESHOLD = -0.045
#: At most so many labelled documents make the target: those whose ids' hashes are the least.
TARGET_DOCS = 10_000
#: Weights are whole numbers in units of this, so that sums don't depend on their order.
UNIT = 1_000_000

_GAP = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    """The runs of other characters than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda x: x != "")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _index(first: int, n: Column) -> Column:
    return F.sequence(F.lit(first), n)


def paired(h: Column, step: int) -> Column:
    """From hashes of windows at each place, those of windows twice as long: two that lie step apart."""
    n = F.size(h)
    none = F.array().cast("array<bigint>")
    return F.when(n <= step, none).otherwise(F.transform(_index(step, n - 1), lambda i: F.xxhash64(F.get(h, i - step), F.get(h, i))))


def covered(h: Column, size: int = 8) -> Column:
    """How many words lie in windows that occur twice or more, from the windows' hashes h."""

    def repeated(s):
        twice = lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twice), lambda e: e["i"]))

    at = _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)
    start = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: list[Column] = ()) -> DataFrame:
    """(row..., id, one, two, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each row."""
    own = [c.alias(f"row{i}") for i, c in enumerate(row)]
    rows = [f"row{i}" for i in range(len(row))]
    text = F.coalesce(docs[text_col], F.lit(""))
    long = lambda c: c.cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    d = docs.select(
        *own, docs[id_col].alias("id"), words(docs[text_col]).alias("words"), lines.alias("lines"),
        long(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    d = d.select(
        *rows, "id", "words", long(F.size("words")).alias("n_words"), long(F.length(F.array_join("words", ""))).alias("word_chars"), "n_symbols",
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.transform("words", lambda x: F.xxhash64(x)).alias("one"),
    )
    names = [*rows, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "one"]
    d = d.select(*names, paired(F.col("one"), 1).alias("two"))
    d = d.select(*names, "two", paired(F.col("two"), 2).alias("h"))
    d = d.select(*names, "two", paired(F.col("h"), 4).alias("h"))
    repeat = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("bigint")).otherwise(covered(F.col("h")))
    d = d.select(*names, "two", repeat.alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def bucket(h: Column) -> Column:
    """The bucket of an n-gram's hash: its last bits, BUCKETS being a power of two."""
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most TARGET_DOCS ids with label 1: those whose hashes are the least. Null ids and labels count for nothing."""
    good = labels.select(labels[id_col].alias("id"), labels[label_col].alias("q")).groupBy("id").agg(F.min("q").alias("q"))
    good = good.where("q = 1 and id is not null").select("id")
    return good.orderBy(F.xxhash64("id"), "id").limit(TARGET_DOCS)


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The log ratio of each bucket, in units of 1 / UNIT: a model of fixed size.

    Where the labels name no good document that docs holds, both multinomials are the raw corpus's
    and all weights are 0, so that nothing is rejected for want of a target.
    """
    good = F.broadcast(trusted_ids(labels, id_col)).withColumn("good", F.lit(1))
    d = docs.select(docs[id_col].alias("id"), F.transform(words(docs[text_col]), lambda x: F.xxhash64(x)).alias("one")).join(good, "id", "left")
    h = F.explode(F.concat("one", paired(F.col("one"), 1)))
    g = d.select(h.alias("h"), F.coalesce("good", F.lit(0)).alias("good")).select(bucket(F.col("h")).alias("g"), "good")
    counts = {r.g: (r.raw, r.target) for r in g.groupBy("g").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()}
    n_raw = sum(r for r, _ in counts.values())
    n_target = sum(t for _, t in counts.values())
    if not n_target:
        return [0] * BUCKETS
    from math import log

    share = n_target / n_raw
    return [round(UNIT * log((t + SMOOTH) / (r * share + SMOOTH))) for r, t in (counts.get(i, (0, 0)) for i in range(BUCKETS))]


def ruled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[int] | None = None) -> DataFrame:
    """For each row of docs its base figures, llr DOUBLE (mean log ratio, null without words) and kept.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr. A
    null text has no words and fails. Equal rows get equal verdicts; a null id is scored as any other;
    extra columns aren't read; an empty table gives an empty result. Windows are compared by 64-bit
    hashes within one text. The labels' sample is the only side that is broadcast and is bounded.
    """
    model = weights(docs, labels, id_col, text_col) if model is None else model
    d = _judged(base(docs, id_col, text_col), model)
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def without_bad(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that ruled() keeps."""
    row = F.struct("*")
    d = _judged(base(docs, id_col, text_col, [row]), weights(docs, labels, id_col, text_col))
    return d.where("kept").select(*(F.col("row0").getField(c).alias(c) for c in docs.columns))


def _judged(d: DataFrame, model: list[int]) -> DataFrame:
    """base()'s rows with llr and kept."""
    known = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    zero = F.lit(0).cast("bigint")
    total = sum(F.aggregate(h, zero, lambda acc, g: acc + F.get(known, bucket(g))) for h in ("one", "two"))
    n = F.size("one") + F.size("two")
    d = d.withColumn("llr", F.when(n > 0, total / (n * float(UNIT))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= THRESHOLD, F.lit(False))
    # the row number keeps the optimizer from copying the whole computation of kept into a filter on it
    return d.withColumn("kept", kept & (F.monotonically_increasing_id() >= 0))


def base_sql(table: str = "documents") -> str:
    """DuckDB SQL for the base figures (all columns of ruled() but kept and llr)."""
    return rf"""
with w as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, row_number() over () as r from {table}),
win as (select r, unnest(range(1, len(words) - 6)) as i, words from w where len(words) >= 8),
dup as (select r, i, count(*) over (partition by r, words[i:i+7]) as c from win),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from dup where c > 1) group by r),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w)
select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
  (len(words) < 20 or 100 * coalesce(n, 0) > 30 * len(words)) as base_failed
from l left join hit using (r)"""
