"""Collections: tables, TREC, HTML and INEX files, with gzip and type detection, and their parse."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlspark.functions import mime
from trawlspark.functions.inverted import Slice, slices
from trawlspark.functions.markup import machine


def from_table(df: DataFrame, docno: str, raw: str, aux: str | None = None, source: str | None = None, type: str = mime.HTML) -> DataFrame:
    """(docno, aux, source, type, raw) from a table with one document a row."""
    lit = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    return df.select(F.col(docno).cast("long").alias("docno"), F.coalesce(lit(aux), F.col(docno).cast("string")).alias("aux"), lit(source).alias("source"), F.lit(type).alias("type"), F.coalesce(F.col(raw), F.lit("")).alias("raw"))


def _inflate(content: bytes) -> bytes:
    """Undo gzip as often as it was applied."""
    while content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    return content


def read_files(spark: SparkSession, paths: str | list[str], type: str | None = None) -> DataFrame:
    """Files of any known type -> documents (aux, source, type, start, raw, compressed), split at end tags.

    The type is guessed from each file's first bytes unless given (TREC, HTML, INEX or a content type).
    Gzip is recognised by its magic number, whatever the name. TREC and INEX documents carry their own
    id; an HTML file is one document and its id is file://<path>.
    """
    fixed = mime.NAMES.get(type or "", type)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    schema = "aux string, source string, type string, start long, raw string, compressed boolean"

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                plain = _inflate(content)
                kind = fixed or mime.guess_bytes(plain)
                raw = plain.decode("utf-8", "replace")
                m = machine(kind)
                for start, end in m.spans(raw):
                    part = raw[start:end]
                    aux = m.one(part, start, end).aux if m.s.end else "file://" + re.sub(r"^file:/*", "/", path)
                    rows.append((aux, path, kind, start, part, plain is not content))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()])], names=["aux", "source", "type", "start", "raw", "compressed"])

    return files.mapInArrow(run, schema)


def read_file_list(spark: SparkSession, path: str, type: str | None = None) -> DataFrame:
    """The files whose names, split by white space, a list file holds."""
    names = [w for r in spark.read.text(path).collect() for w in r.value.split()]  # names, not contents
    return read_files(spark, names, type)


def filled(collection: DataFrame) -> DataFrame:
    """(docno, aux, source, type, raw) of a collection, whatever columns it has; no null texts or types."""
    have = set(collection.columns)
    c = collection.select("docno", *((F.col(n) if n in have else F.lit(None).cast("string")).alias(n) for n in ("aux", "source", "type")), F.coalesce("raw", F.lit("")).alias("raw"))
    return c.withColumn("type", F.coalesce("type", F.lit(mime.HTML)))


def in_slices(collection: DataFrame, schema: str, rows: Callable[[Slice], Iterable[pa.RecordBatch]], stem: Callable[[str], str] | None = None, stop: Iterable[str] = ()) -> DataFrame:
    """Apply a function to a collection's documents, parsed and inverted in slices of bounded size."""

    def run(batches):
        for s in slices(batches, stem, stop):
            yield from rows(s)

    return filled(collection).mapInArrow(run, schema)


def with_occurrences(collection: DataFrame) -> DataFrame:
    """(docno, aux, source, type, raw, title, occ): occ is an array of (term, pos), unstemmed."""

    def rows(s: Slice):
        d, occ = s.docs(), s.occurrences()
        for at in range(0, d.num_rows, 256):
            part = d.slice(at, 256)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("docno", "aux", "source", "type", "raw", "title")), occ.slice(at, 256)], names=["docno", "aux", "source", "type", "raw", "title", "occ"])

    schema = "docno long, aux string, source string, type string, raw string, title string, occ array<struct<term:string,pos:int>>"
    return in_slices(collection, schema, rows)
