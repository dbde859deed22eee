"""Tokens, positions, stems and string functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .porter import porter

WHITE = r"[ \t\n\x0b\f\r]"
_PUNCT = r"[\x22-\x2d\x2f:-\x3e@\[-`{-~]"  # ASCII punctuation but . ! ?
_JOIN = rf"(?:(?:[.!?]?{_PUNCT}[.!?]?|[.!?])[A-Za-z0-9]+)*"
#: A word of markup-free text: alphanumeric runs that one punctuation mark joins.
TOKEN = rf"[A-Za-z0-9]+{_JOIN}"
#: Bytes that are deleted, also inside words.
JUNK = r"[\x01-\x08\x0e-\x1f\x7f]|[^\x00-\x7f]"
_BREAK = "\x01"
_END = rf"(?!(?:[A-Z]\.)+{WHITE})({TOKEN}(?:[.!?]?{_PUNCT})?[.!?]){WHITE}"
#: Longer words take a position but aren't indexed.
MAX_WORD = 49


def clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), JUNK, "")


def strip_word(word: Column) -> Column:
    """ASCII letters and digits of a word, in lower case."""
    return F.lower(F.regexp_replace(word, "[^A-Za-z0-9]", ""))


def terms(text: Column) -> Column:
    """The words of markup-free text in order, long ones too."""
    return F.transform(F.regexp_extract_all(clean(text), F.lit(TOKEN), F.lit(0)), strip_word)


def sentences(text: Column) -> Column:
    """The words by sentence: a word with . ! or ? and white space behind it ends one, an acronym doesn't."""
    return F.transform(F.split(F.regexp_replace(clean(text), _END, "$1" + _BREAK), _BREAK), lambda s: F.transform(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)), strip_word))


def occurrences(words_by_sentence: Column) -> Column:
    """array<struct<term, pos>>: positions count words, one more between sentences unless a long word ends the first.

    The sentences' first positions are summed once for each sentence, so the cost is linear in words.
    """
    zero = F.array(F.lit(0))

    def step(acc, words):
        gap = F.when((F.size(words) > 0) & (F.length(F.element_at(words, -1)) > MAX_WORD), 0).otherwise(1)
        return F.concat(acc, F.array(F.element_at(acc, -1) + F.size(words) + gap))

    bases = F.aggregate(F.transform(words_by_sentence, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit("")).cast("array<string>"))), zero, step)
    # an empty last part holds no word; positions inside it don't matter
    def numbered(b):
        return F.flatten(F.transform(words_by_sentence, lambda w, j: F.transform(w, lambda t, k: F.struct(t.alias("term"), (F.get(b, j) + k).alias("pos")))))

    return F.filter(F.get(F.transform(F.array(bases), numbered), F.lit(0)), lambda o: F.length(o["term"]) <= MAX_WORD)


def stem_eds(term: Column) -> Column:
    """Strip one of ed, e, s behind the first two letters."""
    return F.regexp_replace(term, "^(..+?)(?:ed|e|s)$", "$1")


def stem_light(term: Column) -> Column:
    """ies and ied become y; else one of e es s ed ing ly ingly goes; words in -ie stay; two letters always stay."""
    return (
        F.when(term.rlike("^..+?(?:ies|ied)$") | term.rlike("^..(?:ies|ied)$"), F.regexp_replace(term, "^(..+?|..)(?:ies|ied)$", "$1y"))
        .when(term.rlike("^..+ie$"), term)
        .otherwise(F.regexp_replace(term, "^(..+?)(?:ingly|ing|ly|ed|es|e|s)$", "$1"))
    )


@F.pandas_udf(StringType())
def stem_porter(term: pd.Series) -> pd.Series:
    return term.map(porter, na_action="ignore")


#: Stemmers by name. Porter's runs in Python: apply it to distinct terms.
STEMMERS: dict[str, Callable[[Column], Column]] = {"none": lambda t: t, "eds": stem_eds, "light": stem_light, "porters": stem_porter}
BUILT_IN = dict(STEMMERS)


def register_stemmer(name: str, stemmer: Callable[[Column], Column]) -> None:
    """Make a stemmer of one's own known by name."""
    STEMMERS[name] = stemmer


def stemmed(df: DataFrame, column: str, stemmer: str) -> DataFrame:
    """df with a column of terms stemmed; a Python stemmer sees each distinct term once."""
    if stemmer == "none":
        return df
    if stemmer != "porters":
        return df.withColumn(column, STEMMERS[stemmer](F.col(column)))
    stems = df.select(F.col(column).alias("__t")).distinct().withColumn("__s", stem_porter("__t"))
    return df.join(stems, F.col(column) == F.col("__t")).withColumn(column, F.col("__s")).drop("__t", "__s")


# string utilities of the reference's interface


def ltrim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WHITE}+", "")


def rtrim(x: Column) -> Column:
    return F.regexp_replace(x, rf"{WHITE}+$", "")


def dirname(x: Column) -> Column:
    return F.when(F.locate("/", x) == 0, F.lit(".")).otherwise(F.regexp_replace(x, "/[^/]*$", ""))


def basename(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def casecmp(a: Column, b: Column) -> Column:
    """Whether two strings are equal but for ASCII case."""
    return F.translate(a, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == F.translate(b, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def string_hash(x: Column) -> Column:
    return F.xxhash64(x)
