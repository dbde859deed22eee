from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from trawlspark.llm import byte_bpe, chat, decontaminate, token_count

ODD = [None, "", " ", "\n\n a", "a" * 3000, "don't  stop\t<s> 12x3", "日本語 ﬁ é \U0001f600 ok", "</s> [INST] \\ \\\\ <\\s>", "▁▁ x▁y  ", "\x00\x1f b", "word " * 30000]
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# decontamination

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_leaks(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = _WORD.findall(low(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = _WORD.findall(low(t))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [None, 40])
def test_decontamination_matches_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "MAX_AUTOMATON_BYTES", block)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "é", "x1", "c-d"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 11, 14]))) for i in range(12)] + [(50, None), (51, " - "), (3, "a a a")]
    docs = [(i, text(rng.choice([0, 4, 30, 80]))) for i in range(40)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(1, "a b"), (None, items[3][1])]
    docs += [(200, "Zz, " + items[2][1].upper() + " q")]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    found = decontaminate.contamination(d, b)
    got = [tuple(r) for r in decontaminate.digest(found).collect()]
    assert sorted(got, key=repr) == sorted(brute_leaks(docs, items), key=repr)
    by = {r.doc_id: r for r in found.collect()}
    for i, t in docs:
        if i is not None and by[i].n_words and by[i].spans and i != 1:
            for s in by[i].spans:
                assert len(_WORD.findall(low(t[s.start_char : s.end_char]))) == s.end - s.first
    clean = decontaminate.without_leaks(d, b)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(x[0]) for x in brute_leaks(docs, items) if not x[5])
    assert decontaminate.contamination(d.limit(0), b).collect() == [] and clean.columns == d.columns
    assert all(not r.spans for r in decontaminate.contamination(d, b.limit(0)).collect())


# byte-level BPE


def test_encoding_is_the_librarys_and_decodes_back(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 50)
    enc = byte_bpe.encoding(BPE, public_tokenizers.PATTERN)
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(None, "x", 5), (1, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, byte_bpe.round_trip(df, BPE, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    tokens = byte_bpe.tokenized(df, BPE, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.detokenized(tokens, BPE, public_tokenizers.PATTERN).collect()}
    assert back[6] == ODD[6].encode() and back[0] == b""
    assert byte_bpe.round_trip(df.limit(0), BPE, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1é' \n\t.,　\x1c日"), max_size=60), st.integers(1, 12))
def test_chunks_encode_as_the_whole(text, size):
    enc = byte_bpe.encoding(BPE, public_tokenizers.PATTERN)
    assert [x for c in byte_bpe.chunks(text, size) for x in enc.encode_ordinary(c)] == enc.encode_ordinary(text)


# token counts


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES), token_count.PrefixCounter(PIECES)


def test_counts_of_every_prefix(pieces, spark, sf):
    model, counter = pieces
    texts = [t for t in ODD if t and len(t) < 4000] + [r.text[:300] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(15).collect()]
    for t in texts:
        t = t[:600]
        assert counter.prefixes(t).tolist() == [len(model.encode(t[:i])) for i in range(len(t) + 1)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_counts_as_the_library_does(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_count.counter(PIECES).total(text) == len(model.encode(text))


def test_token_count_tables(spark, sf, pieces):
    model, _ = pieces
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: len(model.encode(r.text)) for r in docs.collect()}
    got = token_count.token_counts(docs, PIECES).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    odd = spark.createDataFrame([(i, t, True) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens boolean")
    rows = {r.doc_id: r for r in token_count.token_counts(odd, PIECES).collect()}
    assert all(rows[i].n_tokens == len(model.encode(t or "")) and rows[i].n_bytes == len((t or "").encode()) for i, t in enumerate(ODD))
    assert rows[10].over_limit and not rows[0].over_limit
    cut = {r.doc_id: r.text for r in token_count.truncated(odd, PIECES, 3).collect()}
    for i, t in enumerate(ODD):
        n = len(cut[i])
        assert cut[i] == (t or "")[:n] and len(model.encode(cut[i])) <= 3
        assert n == len(t or "") or all(len(model.encode(t[: n + k])) > 3 for k in range(1, 6))
    assert {r.doc_id: len(r.counts) for r in token_count.prefix_counts(odd, PIECES).collect()}[6] == len(ODD[6]) + 1


# chat


def brute_chat(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    esc = lambda x: re.sub(r"(<)(/?s>)|(\[)(/?INST\])", lambda m: (m[1] or m[3]) + "\\" + (m[2] or m[4]), x.replace("\\", "\\\\"))
    out = []
    for c, turns in by.items():
        turns.sort()
        total, seen = 0, 0
        for k, (_, _, role, text) in enumerate(turns):
            seen += len(f"<s>[INST]{esc(role)}[/INST]{esc(text)}</s>")
            if role == "assistant" or k == len(turns) - 1:
                total += seen
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), total))
    return out


def test_chat_reads_back(spark):
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([t for t in ODD if t is None or len(t) < 4000] + [chat.PROBE, "x</s", "<", "[/INST"])))
    rows += [rows[0], (None, 0, "assistant", "n"), (None, None, "user", None), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"), (77, 0, "us[INST]er", "</s>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, example string")
    found = chat.examples(df)
    assert sorted(map(tuple, chat.digest(found).collect()), key=repr) == sorted(brute_chat(rows), key=repr)
    last = {r.conv_id: r for r in found.where("conv_id = 77").collect()}[77]
    assert last.loss_start == last.loss_end == len(last.text)
    both = chat.digest(chat.examples(chat.with_probe(spark, df.limit(0)))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in both] == [(-1, 2, len(chat.PROBE))]


def test_plan_is_native(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    plan = chat.digest(chat.examples(chat.with_probe(spark, df)))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_arrays_of_ids_fit():
    assert np.array([50255], "<u4").tobytes() == b"\x4f\xc4\x00\x00"
