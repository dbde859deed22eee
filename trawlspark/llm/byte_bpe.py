"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import map_lists

#: Longer texts are cut at safe boundaries into chunks of about this many characters.
CHUNK = 1 << 16
#: Behind a character that is no white space and before a space or line break: no match of the
#: pattern crosses that place, and none before it looks beyond it.
_SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\r\t])")


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Parts of a text that encode to the same ids one by one as the whole."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    """The ids of a text, without special tokens; null is the empty text."""
    out: list[int] = []
    for part in chunks(text or ""):
        out += enc.encode_ordinary(part)
    return out


def tokenized(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids ARRAY<INT>) of each row. Null and empty texts have no ids; other columns aren't read."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        enc = encoding(path, pattern)
        return lambda ids, texts: (ids, [encode(enc, t) for t in texts])

    return map_lists(docs.select(docs[id_col], docs[text_col]), make, f"{id_col} {kind}, ids array<int>")


def detokenized(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes BINARY): the raw bytes of the ids, which need not be valid UTF-8 when a text was cut."""
    kind = dict(tokens.dtypes)[id_col]

    def make():
        enc = encoding(path, pattern)
        return lambda ids, tokens: (ids, [enc.decode_bytes(t or []) for t in tokens])

    return map_lists(tokens.select(tokens[id_col], tokens[ids_col]), make, f"{id_col} {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded in one pass.

    Every row comes back: null and empty texts with 0 tokens and the digests of nothing; texts of any
    length whole, in chunks cut where no match of the pattern crosses.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        enc = encoding(path, pattern)

        def f(ids, texts):
            n, a, b = [], [], []
            for t in texts:
                tokens = encode(enc, t)
                n.append(len(tokens))
                a.append(hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(enc.decode_bytes(tokens)).hexdigest())
            return ids, n, a, b

        return f

    return map_lists(docs.select(docs[id_col], docs[text_col]), make, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
