"""Token counts by prefix dynamic programming over a SentencePiece BPE vocabulary.

No piece has a word mark behind another character, so merges never cross from a character into the
next word mark: the text falls into units (marks, then other characters). Within a unit the tokens
of each prefix are the tokens of a shorter prefix and one last piece. Which piece it is follows from
compatibility: the last two pieces, merged on their own, must stay those two. So one pass gives the
exact count at every prefix, and truncation and budget questions need no further encoding.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_lists

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Distinct units and pairs kept in a task; beyond, the store starts anew.
KEPT_UNITS, KEPT_TOTALS, KEPT_PAIRS = 200_000, 1_000_000, 600_000


class PrefixCounter:
    """Counts of a piece model at every prefix of a text, as the library would count that prefix."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in usable}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece crosses a word mark; units aren't independent")
        # only pieces that the merges of their own characters lead to ever occur
        self.cost = {p for p in self.score if len(p) == 1 or self.merge(p) == [p]}
        self.begins = {p[:n] for p in self.cost for n in range(1, len(p) + 1)}
        self.units: dict[str, list[int]] = {}
        self.totals: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces of a short string: again and again the best pair, the first of equals."""
        parts, score = list(text), self.score
        never = float("-inf")
        gain = [score.get(x + y, never) for x, y in zip(parts, parts[1:])]
        while gain:
            best = max(gain)
            if best == never:
                break
            i = gain.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = score.get(parts[i - 1] + parts[i], never)
            if i < len(gain):
                gain[i] = score.get(parts[i] + parts[i + 1], never)
        return parts

    def fits(self, a: str, b: str) -> bool:
        k = (a, b)
        known = self.pairs.get(k)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[k] = self.merge(a + b) == [a, b]
        return known

    def unit(self, u: str) -> list[int]:
        """Counts at prefixes 1, 2, ... of a unit."""
        known = self.units.get(u)
        if known is None:
            known = self._unit(u)
            if len(self.units) >= KEPT_UNITS:
                self.units.clear()
            if len(u) <= 64:
                self.units[u] = known
        return known

    def _unit(self, u: str) -> list[int]:
        cost, begins, pairs, n = self.cost, self.begins, self.pairs, len(u)
        last, count = [""] * (n + 1), [0] * (n + 1)
        starts: list[list[int]] = [[] for _ in range(n + 1)]  # of pieces that end at each place, longest first
        for i in range(n):
            j = i + 1
            piece = u[i:j]
            while piece in begins:
                if piece in cost:
                    starts[j].append(i)
                j += 1
                if j > n:
                    break
                piece = u[i:j]
        for j in range(1, n + 1):
            for i in starts[j]:
                piece = u[i:j]
                if i:
                    k = last[i], piece
                    ok = pairs.get(k)
                    if ok is None:
                        ok = self.fits(*k)
                    if not ok:
                        continue
                last[j], count[j] = piece, count[i] + 1
                break
            else:  # no piece: the character's bytes
                piece = u[j - 1]
                last[j], count[j] = piece, count[j - 1] + len(piece.encode())
        return count[1:]

    def _marked(self, text: str) -> str:
        return MARK + text.replace(" ", MARK)

    def total(self, text: str | None) -> int:
        """The number of tokens of a text; null is the empty text."""
        if not text:
            return 0
        totals, n = self.totals, 0
        for u in _UNIT.findall(self._marked(text)):
            c = totals.get(u)
            if c is None:
                if len(totals) >= KEPT_TOTALS:
                    totals.clear()
                c = self._unit(u)[-1]
                if len(u) <= 64:
                    totals[u] = c
            n += c
        return n

    def prefixes(self, text: str | None) -> np.ndarray:
        """counts[i]: tokens of text[:i], for each i from 0 to the text's length."""
        if not text:
            return np.zeros(1, np.int64)
        out, before = [], 0
        for u in _UNIT.findall(self._marked(text)):
            c = self.unit(u)
            out += [before + x for x in c]
            before += c[-1]
        return np.array([0, *out[1:]], np.int64)  # the first mark is the library's own

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix of at most that many tokens."""
        counts = self.prefixes(text)
        return (text or "")[: int(np.flatnonzero(counts <= budget)[-1])]


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; a null text counts as empty; other columns aren't read."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        c = counter(path)

        def f(ids, texts):
            n = [c.total(t) for t in texts]
            return ids, [len((t or "").encode()) for t in texts], n, [x > limit for x in n]

        return f

    return map_lists(docs.select(docs[id_col], docs[text_col]), make, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts ARRAY<INT>): tokens of every prefix, by characters, from the empty one to the whole text."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        c = counter(path)
        return lambda ids, texts: (ids, [c.prefixes(t).tolist() for t in texts])

    return map_lists(docs.select(docs[id_col], docs[text_col]), make, f"{id_col} {kind}, counts array<int>")


def truncated(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the longest prefix within a budget of tokens; a null text gives the empty one."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        c = counter(path)
        return lambda ids, texts: (ids, [c.truncate(t, budget) for t in texts])

    return map_lists(docs.select(docs[id_col], docs[text_col]), make, f"{id_col} {kind}, {text_col} string")
