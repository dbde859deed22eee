"""Stop lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import STEMMERS, rtrim, ltrim

#: English function words, for query stopping where no list is given.
DEFAULT = (
    "i me my myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves this that these those there here who whom whose which what when where why how "
    "am is are was were be been being have has had having do does did doing will would shall should can could may might must ought "
    "a an the and or nor but if because as until while although though unless than so yet of at by for with without about against between "
    "among into through during before after above below to from up upon down in out on off over under again further then once "
    "all any both each every few more most much many other another some such no not none only own same too very just also ever never "
    "always often perhaps however therefore thus hence moreover meanwhile otherwise else instead rather quite almost already still even "
    "within along across toward towards onto per via"
).split()


def stop_frame(spark: SparkSession, words: list[str] | None = None, stemmer: str = "none") -> DataFrame:
    """(term) of a stop list, stemmed as the index is, so that it meets stemmed terms."""
    words = sorted({w.lower() for w in (DEFAULT if words is None else words)})
    df = spark.createDataFrame([(w,) for w in words], "term string")
    return df.select(STEMMERS[stemmer](F.col("term")).alias("term")).distinct()


def read_stop_file(spark: SparkSession, path: str) -> list[str]:
    """Words of a stop file: one a line, white space trimmed, # begins a comment line; repeats are fine."""
    lines = spark.read.text(path).select(ltrim(rtrim(F.col("value"))).alias("w")).where("w <> '' and not startswith(w, '#')")
    return [r.w for r in lines.distinct().orderBy("w").collect()]
