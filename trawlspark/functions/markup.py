"""Markup: lexer, tag state machine and document splitting, run in batches by mapInArrow."""

from __future__ import annotations

import html as _html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

from .mime import HTML, INEX, TREC, guess_bytes
from .text import JUNK, MAX_WORD, TOKEN, WHITE, _PUNCT

_LEX = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))|(?P<cdata><!\[CDATA\[.*?(?:\]\]>|\Z))|(?P<tag><[/?!A-Za-z0-9._:-][^<>]{0,998}>)|(?P<text>[^<]+|<)", re.S
)
_NAME = re.compile(r"[/?!]?[A-Za-z0-9._:-]+")
_WORD = re.compile(rf"({TOKEN})((?:[.!?]?{_PUNCT})?[.!?]{WHITE})?")
_ACRONYM = re.compile(rf"(?:[A-Z]\.)+{WHITE}")
_JUNK = re.compile(JUNK)
_ENTITY = re.compile(r"&(?:(lt|gt|amp|quot|apos|nbsp)|#(\d{1,3})|#[xX]([0-9a-fA-F]{1,2}));?")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " "}


def entities(text: str) -> str:
    """Decode the few entities that count; others stay as they are."""

    def one(m: re.Match) -> str:
        if m[1]:
            return _NAMED[m[1]]
        code = int(m[2]) if m[2] else int(m[3], 16)
        return chr(code) if 0 < code < 255 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


@dataclass
class Settings:
    """What each tag of a type does: index, off, pop, noop, offend, identifier, binary, title; flow tags don't end sentences."""

    tags: dict[str, str] = field(default_factory=dict)
    flow: set[str] = field(default_factory=set)
    end: str | None = None


_FLOW = "link meta bdo a b big font i s small strike sub sup tt u acronym address cite code del dfn em kbd q samp strong var span".split()
_OFF = ("sgmlcomment", "javascript", "profile", "script", "style", "vbscript")


def _settings(off: tuple[str, ...], end: str | None = None, flow: bool = True, **more: str) -> Settings:
    tags = {t: "off" for t in (*_OFF, *off)} | {"/sgmlcomment": "pop", "title": "title"}
    tags |= {"/" + t: "off" for t in ("javascript", "script", "style", "vbscript")}
    tags |= {k.replace("_", "/"): v for k, v in more.items()}
    open_ = [*(_FLOW if flow else ()), "sgmlcomment", "javascript", "script", "style", "vbscript"]
    return Settings(tags, {x for t in open_ for x in (t, "/" + t)}, end)


_CLOSING = {"/" + t: "index" for t in ("javascript", "script", "style", "vbscript")}
SETTINGS: dict[str, Settings] = {
    HTML: _settings(("dochdr",)),
    TREC: _settings(("au", "byline", "dateline", "docid", "docoldno", "fileid", "first", "ht", "parent", "second"), "/doc", docno="identifier", dochdr="offend", _dochdr="binary"),
    INEX: _settings(("dochdr",), "/article", False, dirpath="identifier"),
}
for _s in SETTINGS.values():
    _s.tags |= _CLOSING
SETTINGS[TREC].tags["/vbscript"] = "off"


def load_settings(xml: str) -> dict[str, Settings]:
    """Settings from an XML file's text: <psettings><type mimetype endtag default><tag name index flow/>."""
    out = {}
    for kind in ET.fromstring(xml).iter("type"):
        s = Settings(end=kind.get("endtag"))
        for t in kind.iter("tag"):
            name, index = t.get("name").lower(), t.get("index", "true")
            s.tags[name] = {"true": "index", "false": "off"}.get(index, index)
            if t.get("flow") == "true":
                s.flow.add(name)
        out[kind.get("mimetype")] = s
    return out


def segments(raw: str) -> Iterator[tuple[str, str]]:
    """(kind, value): tag (names in lower case; comments as tags) or text to be cut into words."""
    for m in _LEX.finditer(raw):
        kind, value = m.lastgroup, m[0]
        if kind == "text":
            yield "text", entities(value)
        elif kind == "comment":
            yield "tag", "sgmlcomment"
            yield "text", value[4:-3] if value.endswith("-->") else value[4:]
            yield "tag", "/sgmlcomment"
        elif kind == "cdata":
            yield "text", value[9:-3] if value.endswith("]]>") else value[9:]
        else:
            name = _NAME.match(value, 1)
            if name is None:
                yield "text", value
                continue
            n = name[0].lower()
            yield "tag", n
            if value.endswith("/>") and not n.startswith("/"):
                yield "tag", "/" + n.rstrip("/")


def lex(raw: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, end): segments with text cut into words, each with its sentence flag."""
    for kind, value in segments(raw):
        if kind == "tag":
            yield "tag", value, False
        else:
            yield from words(value)


def words(text: str) -> Iterator[tuple[str, str, bool]]:
    for m in _WORD.finditer(_JUNK.sub("", text) + " "):
        yield "word", m[1], bool(m[2]) and not _ACRONYM.fullmatch(m[0])


def extract_words(text: str, limit: int | None = None) -> list[str]:
    """The indexed form of a text's words, markup left out."""
    out = []
    for kind, value, _ in lex(text):
        if kind == "word":
            out.append(re.sub("[^A-Za-z0-9]", "", value).lower())
            if limit is not None and len(out) >= limit:
                break
    return out


@dataclass
class Parsed:
    """One document of a file."""

    aux: str = ""
    title: str = ""
    kind: str = ""
    start: int = 0
    end: int = 0
    occurrences: list[tuple[str, int]] = field(default_factory=list)


class Machine:
    """The tag state machine: a stack of on and off, off tags, identifiers, headers and binary content."""

    def __init__(self, settings: Settings, kind: str):
        self.s, self.kind = settings, kind

    def documents(self, raw: str) -> Iterator[Parsed]:
        """The documents of a file, split at the type's end tag."""
        at = 0
        for start, end in self.spans(raw):
            yield self.one(raw[start:end], start, end)
            at = end
        if self.s.end is None and at == 0:
            yield self.one(raw, 0, len(raw))

    def spans(self, raw: str) -> Iterator[tuple[int, int]]:
        if self.s.end is None:
            yield 0, len(raw)
            return
        at = 0
        for m in re.finditer(rf"(?i)<{re.escape(self.s.end)}(?:\s[^<>]{{0,900}})?>", raw):
            yield at, m.end()
            at = m.end()
        if raw[at:].strip():
            yield at, len(raw)

    def one(self, raw: str, start: int, end: int) -> Parsed:
        doc, text = self.scan(raw, start, end)
        pos = 0
        for _, value, end_flag in words(text):
            term = re.sub("[^A-Za-z0-9]", "", value).lower()
            if len(term) > MAX_WORD:
                pos += 1
                continue
            doc.occurrences.append((term, pos))
            pos += 1 + end_flag
        return doc

    def scan(self, raw: str, start: int = 0, end: int = 0) -> tuple[Parsed, str]:
        """The document without its words, and the text that is indexed, with white space where tags were."""
        doc = Parsed(kind=self.kind, start=start, end=end)
        on, stack, mode, until = True, [], "", ""
        title_open, title, texts = False, [], []
        if "identifier" in self.s.tags.values():
            name = next(t for t, a in self.s.tags.items() if a == "identifier")
            m = re.search(rf"(?is)<{name}(?:\s[^<>]*)?>([^<]*)", raw)
            doc.aux = m[1].strip() if m else ""
        tags = self.s.tags
        for kind, value in segments(raw):
            if kind == "text":
                if mode == "id" or mode == "ignore" or not (on or title_open or mode):
                    continue
                if title_open or mode == "binary":
                    value, mode, doc.kind = self._watched(value, mode, doc.kind, title if title_open else None)
                    until = "" if mode == "ignore" else until
                if on and value:
                    texts.append(value)
                continue
            title_open = False
            if mode == "ignore" and value != until and value != self.s.end:
                continue
            was, mode = (on if mode not in ("ignore",) else False) or mode in ("id", "binary"), ""
            act = tags.get(value, "index")
            if value == self.s.end:
                break
            if act in ("index", "title"):
                stack.append(was)
                on, title_open = True, act == "title"
            elif act == "off":
                stack.append(was)
                on = False
            elif act == "pop":
                on = stack.pop() if stack else True
            elif act == "identifier":
                mode = "id"
            elif act == "binary":
                mode, on = "binary", True
            elif act == "offend":
                mode, until = "ignore", "/" + value.lstrip("/")
        doc.title = " ".join(title)
        return doc, "\n".join(texts)

    @staticmethod
    def _watched(text: str, mode: str, kind: str, title: list[str] | None) -> tuple[str, str, str]:
        """(text, mode, kind) after the words of a title are kept and binary content is guessed by its first word."""
        for _, value, _ in words(text):
            if title is not None:
                title.append(value)
            if mode == "binary":
                mode = ""
                found = guess_bytes(value.encode("latin-1", "ignore"))
                if not found.startswith(("text/", "application/x-", "application/octet")):
                    return "", "ignore", found
            if title is None:
                break
        return text, mode, kind


def machine(kind: str, settings: dict[str, Settings] | None = None) -> Machine:
    known = settings or SETTINGS
    return Machine(known.get(kind) or known[HTML], kind)


def escape_html(text: str) -> str:
    """For summaries: markup characters by name, control characters, apostrophes and others by number."""
    named = _html.escape(text, quote=False).replace('"', "&quot;")
    return "".join(c if 32 <= ord(c) < 127 and c != "'" else f"&#{ord(c)};" for c in named)
