"""Query-biased summaries, for the rows of a page."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlspark.functions.markup import SETTINGS, escape_html, lex
from trawlspark.functions.mime import HTML
from trawlspark.functions.porter import porter

LENGTH = 350
_PIE = re.compile(r"^(..+?|..)(?:ies|ied)$")
_LIGHT = re.compile(r"^(..+?)(?:ingly|ing|ly|ed|es|e|s)$")
_EDS = re.compile(r"^(..+?)(?:ed|e|s)$")


def light(t: str) -> str:
    if _PIE.match(t):
        return _PIE.sub(r"\1y", t)
    return t if len(t) > 3 and t.endswith("ie") else _LIGHT.sub(r"\1", t)


PY_STEMMERS = {"none": lambda t: t, "eds": lambda t: _EDS.sub(r"\1", t), "light": light, "porters": porter}


def summarise(raw: str, kind: str, terms: set[str], conjuncts: int, style: str, stem, length: int = LENGTH) -> str:
    """The sentences with most query words, as many as fit, in the document's order.

    A sentence ends at a sentence's end, at a tag that text doesn't flow through, or when it is full.
    """
    s = SETTINGS.get(kind) or SETTINGS[HTML]
    found: list[dict] = []
    now = {"words": [], "hits": [], "n": 0, "start": 0}
    place, size, on, skip = 0, 0, True, ""

    def close() -> None:
        nonlocal now, size
        if now["words"]:
            found.append(now)
        now, size = {"words": [], "hits": [], "n": 0, "start": place}, 0

    for kind_, value, end in lex(raw):
        if kind_ == "tag":
            act = s.tags.get(value, "index")
            if value == "title":
                skip = "title"
            elif skip == "title" and value == "/title":
                skip = ""
            elif act == "off":
                on = False
            else:
                on = True
            if now["words"] and value not in s.flow:
                place += 1
                close()
            continue
        if not on or skip:
            continue
        word = value
        hit = stem(re.sub("[^A-Za-z0-9]", "", word).lower()) in terms
        if style == "tag":
            word = escape_html(word)
        elif style == "capitalise" and hit:
            word = word.upper()
        now["words"].append(word + ("." if end else ""))
        now["hits"].append(hit)
        place += 1
        size += len(word) + 1
        if end or size >= length:
            close()
    close()
    texts = []
    for f in found:
        if style == "tag":
            parts, open_ = [], False
            for w, h in zip(f["words"], f["hits"]):
                parts.append(("<b>" if h and not open_ else "</b> " if open_ and not h else " " if parts else "") + (" " if h and not open_ and parts else "") * 0 + w)
                open_ = h
            text = re.sub(r"(\S)<b>", r"\1 <b>", "".join(parts)) + ("</b>" if open_ else "")
        else:
            text = " ".join(f["words"])
        texts.append((sum(f["hits"]) ** 2 / max(1, conjuncts), f["start"], len(f["words"]), text))
    if not texts:
        return ""
    best = sorted(texts, key=lambda x: (-x[0], -x[1]))
    chosen, used = [best[0]], len(best[0][3])
    for t in best[1:]:
        if used + len(t[3]) + 5 >= length:
            break
        chosen.append(t)
        used += len(t[3]) + 5
    chosen.sort(key=lambda x: x[1])
    out = chosen[0][3]
    for a, b in zip(chosen, chosen[1:]):
        if a[1] + a[2] == b[1]:
            out += "  " + b[3]
        else:
            out += ("... " if out.endswith(".") and b[3][:1].isupper() else " ... ") + b[3]
    return out[: length - 1] if len(out) >= length else out


def summarised(page: DataFrame, rows: list[tuple], stemmer: str, style: str) -> DataFrame:
    """page(type, raw, ...) with a summary; runs on the rows of the page alone."""
    terms, n = frozenset(t for r in rows for t in r[3]), len(rows)

    @F.pandas_udf("string")
    def make(raw: pd.Series, kind: pd.Series) -> pd.Series:
        stem = PY_STEMMERS[stemmer]
        return pd.Series([summarise(r, k, terms, n, style, stem) for r, k in zip(raw, kind)], dtype="object")

    return page.withColumn("summary", make("raw", "type"))
