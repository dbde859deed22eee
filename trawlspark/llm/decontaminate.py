"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows scans each text once."""

from __future__ import annotations

import hashlib
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, map_lists, numberable, written

WINDOW = 10
#: The items' text in one automaton; more items make further passes of this size over the documents.
MAX_AUTOMATON_BYTES = 8 << 20

#: ASCII letters in lower case; other ASCII characters than letters and digits are gaps.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    w = words_of(text)
    if not w:
        return []
    return list({b" ".join(w[i : i + size]): 0 for i in range(max(1, len(w) - size + 1))})


class Scanner:
    """Finds every window of some items in texts."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        owners: dict[bytes, set] = {}
        for item, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).add(item)
        self.owners = [(w.count(b" ") + 1, sorted(o, key=str)) for w, o in owners.items()]
        self.automaton = ahocorasick.Automaton() if owners else None
        for i, w in enumerate(owners):
            # latin-1 keeps one character for each byte; spaces at both ends keep whole words
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(words, merged spans [first, end) of hit words, items found)."""
        words = words_of(text)
        if not words or self.automaton is None:
            return len(words), [], set()
        found = list(self.automaton.iter(" " + b" ".join(words).decode("latin-1") + " "))
        if not found:
            return len(words), [], set()
        ends = np.fromiter(accumulate((len(w) + 1 for w in words)), np.int64, len(words))  # of the space behind each word
        at = np.searchsorted(ends, [e for e, _ in found]) + 1
        items, spans = set(), []
        for end, (_, i) in sorted(zip(at.tolist(), found)):
            n, owners = self.owners[i]
            items.update(owners)
            spans.append((end - n, end))
        merged: list[list[int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        return len(words), [tuple(x) for x in merged], items - {None}


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as offsets of characters in the original text."""
    folded = text.encode().translate(_FOLD)
    if not spans:
        return []
    inside = np.frombuffer(folded, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[first[s]]), int(chars[last[e - 1]])) for s, e in spans]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple]]:
    """The items in blocks of a bounded size, read one after another."""
    blocks, now, used = [], [], 0
    for item, text in benchmark.select(benchmark[item_col], benchmark[text_col]).toLocalIterator():
        if not text:
            continue
        if now and used + len(text) > MAX_AUTOMATON_BYTES:
            blocks.append(now)
            now, used = [], 0
        now.append((item, text))
        used += len(text)
    return [*blocks, now]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """For each row of docs: its id, n_words, spans (of hit words: first and end, and the characters they cover) and items.

    A window is `size` consecutive words of an item, or all its words if fewer. Null and wordless
    texts and items have no windows; items with a null id count for spans but aren't named in items; equal rows come back as often as they came. Extra
    columns aren't read. The items are a query set: they go in blocks of at most MAX_AUTOMATON_BYTES,
    and each block scans all documents once, so what a task holds is bounded whatever their number.
    """
    kind = dict(docs.dtypes)[id_col]
    parts = []
    for block in _blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            scanner = Scanner(shared.value, size)

            def f(rows, ids, texts):
                out = [scanner.scan(t) for t in texts]
                at = [char_spans(t, x[1]) if x[1] else [] for t, x in zip(texts, out)]
                spans = [[(s, e, a, b) for (s, e), (a, b) in zip(x[1], c)] for x, c in zip(out, at)]
                return rows, ids, [x[0] for x in out], [[dict(zip(("first", "end", "start_char", "end_char"), s)) for s in x] for x in spans], [sorted(map(str, x[2])) for x in out]

            return f

        parts.append((shared, make))
    schema = f"__row long, id {kind}, n_words long, spans array<struct<first:long,end:long,start_char:long,end_char:long>>, items array<string>"
    docs = numberable(docs) if len(parts) > 1 else docs
    rows = docs.select(F.monotonically_increasing_id().alias("__row") if len(parts) > 1 else F.lit(0).cast("long").alias("__row"), docs[id_col], docs[text_col])
    scans = [map_lists(rows, make, schema) for _, make in parts]
    found = scans[0]
    if len(scans) > 1:
        hits = [written(x.where(F.size("spans") > 0), "leaks") for x in scans[1:]]
        more = hits[0]
        for x in hits[1:]:
            more = more.union(x)
        more = more.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
        found = found.join(more, "__row", "left")
        found = found.select("__row", "id", "n_words", _merged(F.concat("spans", F.coalesce("s", F.array().cast("array<struct<first:long,end:long,start_char:long,end_char:long>>")))).alias("spans"), F.array_sort(F.array_union("items", F.coalesce("i", F.array().cast("array<string>")))).alias("items"))
    return found.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, that hold no window of an item."""
    place = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            scanner = Scanner(shared.value, size)
            for b in batches:
                yield b.filter(pa.array([not scanner.scan(t)[1] for t in b.column(place).to_pylist()], pa.bool_()))

        docs = filtered(docs, run)
    return docs


def _merged(spans):
    """Overlapping spans as one."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"), last["start_char"].alias("start_char"), F.greatest(last["end_char"], x["end_char"]).alias("end_char"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["first"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    empty = F.array().cast("array<struct<first:long,end:long,start_char:long,end_char:long>>")
    return F.aggregate(F.array_sort(spans), empty, step)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def sha_of(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
