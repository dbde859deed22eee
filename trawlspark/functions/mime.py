"""Content types by magic bytes and first markup."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TREC, INEX, HTML, SGML, XML, OTHER = "application/x-trec", "application/x-inex", "text/html", "text/sgml", "text/xml", "application/octet-stream"
WORD = "application/msword"
_MAGIC = (("FFD8FFE0", "image/jpeg"), ("474946383961", "image/gif"), ("474946383761", "image/gif"), ("D0CF11E0", WORD), ("FF575043", "application/wordperfect5.1"), ("2521", "application/postscript"), ("255044462D", "application/pdf"))
_MARKUP = (("<doc>", TREC), ("<article>", INEX), (r"<!doctype html|<head|<title|<html", HTML), (r"<!doctype |<subdoc", SGML), (r"<\?xml", XML))
NAMES = {"TREC": TREC, "INEX": INEX, "HTML": HTML, "SGML": SGML, "XML": XML}


def guess(content: Column) -> Column:
    """The type of text or binary content: magic numbers in order, then the first markup behind white space."""
    raw = content.cast("binary")
    head = F.hex(F.substring(raw, 1, 6))
    out = None
    for magic, kind in _MAGIC:
        hit = head.startswith(magic)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    text = F.decode(F.substring(raw, 1, 4096), "ISO-8859-1")
    for pattern, kind in _MARKUP:
        out = out.when(text.rlike(rf"(?i)^[ \t-\r]*(?:{pattern})"), kind)
    return out.otherwise(OTHER)


def guess_bytes(content: bytes) -> str:
    """guess() for one value, for parsers."""
    head = content[:6].hex().upper()
    for magic, kind in _MAGIC:
        if head.startswith(magic):
            return kind
    text = content[:4096].decode("latin-1")
    for pattern, kind in _MARKUP:
        if re.match(rf"(?i)[ \t-\r]*(?:{pattern})", text):
            return kind
    return OTHER
