"""WARC archives with a Zstandard dictionary: a leading skippable frame embeds it, each record is a frame of its own."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import fresh_path, local_path, numberable, written

#: Of the skippable frame in front of an archive, which holds the dictionary.
MAGIC = 0x184D2A5D
LEVEL = 3
DICT_BYTES = 64 << 10
#: The dictionary is built from whole records of at most so many pages (those whose ids' hashes are
#: the least) and of at most so many bytes each.
DICT_PAGES, DICT_PAGE_BYTES = 400, 32 << 10
#: Revisits are broadcast up to this many rows (32 bytes each), else joined by row.
BROADCAST_ROWS = 200_000

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def _clean(url: str) -> str:
    """A url without what would end its header line; the rest of its own escapes stay."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]|")


def _name(page: object) -> str:
    """A page's id as a header's value, from which unquote() gives back each character."""
    return quote(str(page), safe="")


def record(page: object, url: str | None, payload: bytes, digest: str, kind: str, refers_to: object) -> bytes:
    """One WARC record. A revisit leaves out the payload; its HTTP header still tells the length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page) if page is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page is not None:
        head.append(f"WARC-Page-Id: {_name(page)}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Refers-To-Page-Id: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from whole records; raw content where they are too few to train on."""
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(DICT_BYTES, records, k=1024, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-DICT_BYTES:] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def write_archive(path: str, records: Iterator[bytes], dictionary: bytes) -> int:
    """Write the records to path, complete or not at all; how many they were."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    held = zstandard.ZstdCompressionDict(dictionary)
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=held)
    n, part = 0, f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(struct.pack("<II", MAGIC, len(packed)) + packed)
        for r in records:
            f.write(squeeze.compress(r))
            n += 1
    os.replace(part, path)
    return n


def _frames(path: str) -> Iterator[bytes]:
    """What each frame behind the dictionary's holds; a frame that ends early is an error."""
    with open(path, "rb") as f:
        start = f.read(8)
        if len(start) < 8 or (sizes := struct.unpack("<II", start))[0] != MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        packed = f.read(sizes[1])
        if len(packed) < sizes[1]:
            raise ValueError(f"{path}: the dictionary is cut off")
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed)))
        left = b""
        while left := left or f.read(1 << 16):
            frame, parts = expand.decompressobj(), []
            while True:
                parts.append(frame.decompress(left))
                if frame.eof:
                    break
                if not (left := f.read(1 << 20)):
                    raise ValueError(f"{path}: a record is cut off")
            left = frame.unused_data
            yield b"".join(parts)


def read_archive(path: str, records: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record, one held at a time; a revisit's payload is empty.

    A record that is cut off is an error, and so is another number of records than `records`.
    """
    n = 0
    for n, whole in enumerate(_frames(path), 1):
        head, _, rest = whole.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"{path}: a record doesn't end where its header says")
        http, _, payload = block.partition(b"\r\n\r\n")
        headers["Payload-Length"] = next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")).decode()
        yield headers, payload
    if records is not None and n != records:
        raise ValueError(f"{path}: {n} records of {records}")


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(row, refers_to) of the rows whose payload an earlier page has: smallest id, then first row."""
    html = F.coalesce(pages[html_col], F.lit(""))
    row = F.monotonically_increasing_id().alias("row")
    meta = pages.select(pages[id_col].alias("id"), row, F.sha1(html.cast("binary")).alias("h"), F.octet_length(html).alias("n"))
    meta = written(meta.where(F.col("n") >= least_bytes).select("id", "row", F.unhex("h").alias("h")), "digests")
    first = meta.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "row")).alias("first"))
    first = first.where("n > 1").select("h", F.col("first.id").alias("refers_to"), F.col("first.row").alias("own"))
    return written(meta.join(first, "h").where(F.col("row") != F.col("own")).select("row", F.lit(True).alias("again"), "refers_to"), "revisits")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives below the shared folder -> (path, records) of each archive.

    Each partition of pages is one archive. A task that runs again writes another file, and only the
    files that the returned table names count. A null html is the empty payload; of rows with equal
    payloads of least_bytes or more one is a response and the rest revisit it; repeated ids stay.
    The shared folder must be mounted on every executor.
    """
    spark = pages.sparkSession
    pages = numberable(pages)
    row = F.monotonically_increasing_id().alias("row")
    again = revisits(pages, id_col, html_col, least_bytes)
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    size = F.octet_length(F.coalesce(pages[html_col], F.lit("")))
    sample = pages.where(size <= DICT_PAGE_BYTES).select(pages[id_col].alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(DICT_PAGES)
    texts = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).join(F.broadcast(sample.distinct()), "id").where(F.octet_length(F.coalesce("html", F.lit(""))) <= DICT_PAGE_BYTES)
    texts = texts.groupBy("id").agg(F.min(F.struct("url", "html")).alias("p")).select("id", "p.url", "p.html").orderBy("id").collect()
    records = []
    for r in texts:
        p = (r.html or "").encode()
        records.append(record(r.id, r.url, p, digest_of(p), "response", None))
    shared = spark.sparkContext.broadcast(build_dictionary(records))
    where = fresh_path(spark, "warc")
    folder = local_path(where)
    rows = pages.select(row, pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).join(again, "row", "left")
    rows = rows.select("id", "url", "html", F.coalesce("again", F.lit(False)).alias("again"), "refers_to")

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"

        def each(first):
            for b in (x for part in ((first,), batches) for x in part):
                for page, url, html, again, to in zip(*(c.to_pylist() for c in b.columns)):
                    p = (html or "").encode()
                    yield record(page, url, p, digest_of(p), "revisit" if again else "response", to)

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            n = write_archive(path, each(first), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(run, "path string, records long"), "archives")


def unarchived(archives: DataFrame, id_type: str, whole_id: bool) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record of the archives.

    The payload of a response is held against its digest; that of a revisit is null. An archive that is cut
    anywhere, or holds another number of records than archives says, is an error. Null ids come back as null,
    ids of text with every character, and no archives give no rows.
    """
    schema = f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, payload binary"
    kind = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}.get(id_type, pa.string())
    read_id = (lambda x: None if x is None else int(x)) if whole_id else (lambda x: None if x is None else unquote(x))

    def run(batches):
        rows: list[tuple] = []

        def batch():
            a = list(zip(*rows)) if rows else [()] * 6
            types = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        held = 0
        for b in batches:
            for path, count in zip(*(c.to_pylist() for c in b.columns)):
                for h, payload in read_archive(path, count):
                    digest, again = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
                    if not again and (digest_of(payload) != digest or len(payload) != int(h["Payload-Length"])):
                        raise ValueError(f"{path}: a payload doesn't match its digest")
                    rows.append((read_id(h.get("WARC-Page-Id")), int(h["Payload-Length"]), digest, h["WARC-Type"], read_id(h.get("WARC-Refers-To-Page-Id")), None if again else payload))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    n = max(1, archives.count())
    return archives.select("path", "records").repartition(n).mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """What the archives of all pages hold, read back: the id, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of pages, repeated ones too; of equal payloads the smallest id is the response, of
    equal ids there the first row. A null html is the empty payload; texts of any length are written whole;
    other columns aren't read; an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType
    back = unarchived(archived(pages, id_col, url_col, html_col, least_bytes), kind.simpleString(), isinstance(kind, IntegralType))
    return back.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select *, sha1(html) as hex, row_number() over (partition by html order by page_id) as i, min(page_id) over (partition by html) as first from p)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::bigint) >> (5 * (3 - i % 4))::int) & 31)::int, 1)), '') as payload_digest,
  case when i = 1 then 'response' else 'revisit' end as record_type, case when i > 1 then first end as refers_to
from h"""
