from __future__ import annotations

import base64
import hashlib
import os
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from trawlspark.llm import sharding, warc
from trawlspark.llm.common import local_path


def test_pages_read_back(spark, monkeypatch):
    rows = [(i, f"http://x/{i}\r\n y", f"<p>{i % 7}</p>" * 50) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<p>é\r\n\r\n</p>"), (103, "u", "z" * 3_000_000), (3, "u", rows[3][2]), (None, "u", rows[4][2]), (None, "u", "only")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, again int").repartition(3)
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=repr)
    first: dict = {}
    for i, _, h in rows:
        k = h or ""
        first[k] = min(first.get(k, (True, 0)), (i is None, i or 0))
    want, done = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        own = (h or "") not in done and (i is None, i or 0) == first[h or ""]
        done.add(h or "")
        want.append((i, len(p), d, "response" if own else "revisit", None if own else first[h or ""][1]))
    assert got == sorted(want, key=repr)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=repr) == got
    assert warc.round_trip(df.limit(0)).collect() == []
    least = warc.round_trip(df, least_bytes=1000).collect()
    assert all(r.record_type == "response" for r in least if r.payload_bytes < 1000)


def test_frames_and_dictionary(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = warc.archived(pages).first().path
    data = open(path, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert magic == 0x184D2A5D and len(dictionary) > 1000
    # one record from the middle is read without those before it
    found, at = 0, 8 + size
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    while at < len(data):
        o = d.decompressobj()
        text = o.decompress(data[at:])
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        at, found = len(data) - len(o.unused_data), found + 1
    assert found == sum(1 for _ in warc.read_archive(path))
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r.html.encode())) for r in pages.collect())
    assert sum(os.path.getsize(r.path) for r in warc.archived(pages).collect()) < plain


def test_cut_archives_and_unmounted_folders_are_errors(tmp_path):
    path = str(tmp_path / "x.warc.zst")
    warc.write_archive(path, iter([warc.record(1, "u", b"abc", warc.digest_of(b"abc"), "response", None)]), b"WARC/1.1")
    assert [p for _, p in warc.read_archive(path)] == [b"abc"]
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 30)
    with pytest.raises(Exception):  # noqa: B017
        list(warc.read_archive(path))
    whole = [warc.record(i, "u", b"abc" * i, warc.digest_of(b"abc" * i), "response", None) for i in range(3)]
    assert warc.write_archive(path, iter(whole), b"WARC/1.1") == 3
    data = open(path, "rb").read()
    for n in range(len(data)):
        with open(path, "wb") as f:
            f.write(data[:n])
        with pytest.raises(Exception):  # noqa: B017
            list(warc.read_archive(path, 3))
    with pytest.raises(ValueError, match="mounted"):
        local_path("hdfs://x/y")


def test_ids_of_text_come_back_as_they_are(spark):
    ids = ["a  b", "a\tb", " c", "", "é%20\r\n", None, "d", "d"]
    pages = spark.createDataFrame([(i, "http://x/ y\r\nz", "same" if i else str(n)) for n, i in enumerate(ids)], "page_id string, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert sorted(map(str, (r.page_id for r in rows))) == sorted(map(str, ids))
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {" c"} and sum(r.record_type == "revisit" for r in rows) == 5


def check_shards(docs, rows, shards):
    assert len(rows) == len(docs)
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in counts)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def shard_frame(spark, docs):
    return spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, shard int").repartition(3)


@pytest.mark.parametrize("bucket", [10**6, 20])
def test_sizes_slots_and_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    docs = [(i, f"t{i}") for i in range(150)] + [(i, f"g{i % 20}") for i in range(200, 300)] + [(None, "g1"), (300, None), (301, ""), (200, "g0"), (302, "é" * 1000)]
    rows = sharding.sharded(shard_frame(spark, docs), 10).collect()
    check_shards(docs, rows, 10)
    text = dict(docs)
    for r in rows:
        t = text[r.doc_id] or ""
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "rows" and r.grown_shard is None
    where = [sorted({r.shard for r in rows if r.doc_id is not None and text[r.doc_id] == f"g{g}"}) for g in range(20)]
    split = [w for w in where if len(w) > 1]
    assert len(split) <= 4 and all(w[1] == w[0] + 1 and len(w) == 2 for w in split)  # cut only where a shard ends
    again = sharding.sharded(shard_frame(spark, docs), 10).collect()
    assert sorted((str(r.doc_id), r.size, r.shard) for r in again) == sorted((str(r.doc_id), r.size, r.shard) for r in rows)


def test_a_group_of_half_of_all_rows_is_cut_as_little_as_can_be(spark):
    docs = [(i, "hot") for i in range(200)] + [(i, f"t{i // 3}") for i in range(200, 400)]
    rows = sharding.sharded(shard_frame(spark, docs), 8).collect()
    check_shards(docs, rows, 8)
    assert len({r.shard for r in rows if r.doc_id < 200}) <= 5
    assert sum(len({r.shard for r in rows if r.doc_id // 3 == g}) > 1 for g in range(67, 133)) <= 7
    only = sharding.sharded(shard_frame(spark, [(i, "hot") for i in range(83)]), 8).collect()
    check_shards([0] * 83, only, 8)


def test_few_and_no_rows(spark):
    assert sharding.sharded(shard_frame(spark, [(1, "a")]).limit(0)).collect() == []
    check_shards([1, 2], sharding.sharded(shard_frame(spark, [(1, "a"), (2, "a")])).collect(), 40)
