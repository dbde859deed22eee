"""The query language: words, OR, AND, phrases, [sloppy:n], [cutoff:n], +word and -word, as conjuncts.

Parsed on the driver, a query at a time; deciding which words are known takes one lookup for all.
Where the reference's parser and tokeniser disagree, documents' tokens win: a phrase's words are cut
as a document's are, over-long words are dropped, runs of punctuation are nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from trawlspark.functions.text import JUNK, MAX_WORD, TOKEN

WORD, AND, PHRASE = "WORD", "AND", "PHRASE"
_PIECE = re.compile(r'"([^"]*)("|$)|\[([^\]\[]*)(\]|$)|(\S*?)(?=["\[\s]|$)|\s', re.S)
_JUNK, _TOKEN = re.compile(JUNK), re.compile(TOKEN)


@dataclass
class Item:
    kind: str  # word, phrase, and, mod
    terms: list[str] = field(default_factory=list)
    plus: bool = False
    name: str = ""
    arg: str = ""


@dataclass
class Conjunct:
    type: str
    terms: tuple[str, ...]
    f_qt: int = 1
    slop: int = 0
    cutoff: int = 0


@dataclass
class Parsed:
    conjuncts: list[Conjunct]
    warnings: list[str]
    cache: int | None = None


def tokens(text: str) -> list[str]:
    found = (re.sub("[^A-Za-z0-9]", "", m).lower() for m in _TOKEN.findall(_JUNK.sub("", text)))
    return [t for t in found if len(t) <= MAX_WORD]


def items(query: str) -> tuple[list[Item], list[str]]:
    """The query's items in order, and warnings."""
    out: list[Item] = []
    warn: list[str] = []
    at = 0
    while at < len(query):
        m = _PIECE.match(query, at)
        if not m or m.end() == at:
            at += 1
            continue
        at = m.end()
        if m[1] is not None:
            if not m[2]:
                warn.append("UNMATCHED QUOTES")
            if "(" in m[1] or ")" in m[1]:
                warn.append("PARENS")
            out.append(Item("phrase", tokens(m[1])))
        elif m[3] is not None:
            if not m[4]:
                warn.append("UNMATCHED BRACKET")
            name, _, arg = m[3].partition(":")
            out.append(Item("mod", name=name.strip().lower(), arg=arg.strip()))
        elif m[5]:
            w = m[5]
            if "(" in w or ")" in w:
                warn.append("PARENS")
            if w == "OR":
                continue
            if w == "AND" and at < len(query) and query[at:].strip():
                out.append(Item("and"))
                continue
            if w[0] == "-":
                if not tokens(w[1:]):
                    warn.append("EMPTY WORD")
                continue  # exclusion is parsed and has no effect
            found = tokens(w)
            if not found and w.strip("()"):
                warn.append("EMPTY WORD")
            out += [Item("word", [t], plus=w[0] == "+" and i == 0) for i, t in enumerate(found)]
    return out, warn


def _number(arg: str) -> int:
    m = re.match(r"\d+", arg)
    return int(m[0]) if m else 0


def parse(query: str, known: Callable[[str], bool], stem: Callable[[str], str] = lambda t: t, stop: Iterable[str] = (), word_limit: int | None = 20) -> Parsed:
    """A query's conjuncts over stemmed terms.

    An unknown word is dropped; in an AND or a phrase it voids the whole, and a word behind an unknown
    one and AND goes with it. Stop words count only where they stand alone. AND binds its neighbours;
    beside a phrase it has no effect. Equal conjuncts are one with f_qt counting them.
    """
    stop = set(stop)
    parts, warn = items(query)
    out: list[Conjunct] = []
    cache, used = None, 0
    last: Conjunct | None = None  # what modifiers change
    chain: list[str] | None = None  # terms of an open AND, None outside
    void = False
    i = 0

    def put(c: Conjunct) -> None:
        nonlocal last
        out.append(c)
        last = c

    def close() -> None:
        nonlocal chain, void
        if chain is not None and not void:
            kept = list(dict.fromkeys(chain))
            put(Conjunct(AND, tuple(kept)) if len(kept) > 1 else Conjunct(WORD, tuple(kept)))
        chain, void = None, False

    while i < len(parts):
        p = parts[i]
        follows = i + 1 < len(parts) and parts[i + 1].kind == "and" and i + 2 < len(parts) and parts[i + 2].kind == "word"
        if p.kind == "word":
            if word_limit is not None and used >= word_limit:
                break
            used += 1
            t = stem(p.terms[0])
            ok = known(t)
            if chain is None and follows:
                if not ok:
                    chain, void = [], True
                elif t in stop and not p.plus:
                    chain = []  # a stopped head: the rest starts anew
                else:
                    chain = [t]
            elif chain is not None:
                if ok:
                    chain.append(t)
                else:
                    void = True
            elif ok and (p.plus or t not in stop):
                put(Conjunct(WORD, (t,)))
            if chain is not None and not follows:
                close()
        elif p.kind == "phrase":
            terms = [stem(t) for t in p.terms]
            if word_limit is not None and used + len(terms) > word_limit:
                break
            used += len(terms)
            if terms and all(map(known, terms)):
                put(Conjunct(PHRASE, tuple(terms)) if len(terms) > 1 else Conjunct(WORD, tuple(terms)))
        elif p.kind == "mod":
            if p.name == "cache":
                cache = _number(p.arg)
            elif last is not None and p.name == "sloppy":
                last.slop = _number(p.arg)
            elif last is not None and p.name == "cutoff":
                last.cutoff = _number(p.arg)
        i += 1
    folded: dict[tuple, Conjunct] = {}
    for c in out:
        k = (c.type, c.terms, c.slop, c.cutoff)
        if k in folded:
            folded[k].f_qt += c.f_qt
        else:
            folded[k] = c
    return Parsed(list(folded.values()), warn, cache)
