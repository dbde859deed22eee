"""LM scoring by unbounded n-grams: suffix arrays over shards of the corpus, longest matching contexts, summed counts.

Four passes. (1) Every text becomes 64-bit token hashes in files below the shared folder, and the
training tokens' counts become a sorted vocabulary there, in files by range. (2) Each file's tokens become
their places in the vocabulary, 32 bits each, beside the places of its suffixes and of what is looked up, by a
hash of their first two tokens. (3) A shard has all training suffixes of a range of these hashes, from all
files: one task splits them, token by token, together with what is looked up and has such a hash: the
held-out texts from every token on, and the training texts from their first token on (a training text
occurs itself, so its longest context is its whole past). So a place is looked up in one shard only, and
suffixes beside which nothing is looked up are left at once. Suffixes go on in the files of the whole corpus, which each task maps in one row.
(4) For each file of the store the shards' counts are summed: the context of a token is the longest
run of tokens before it that occurs in the training texts, and
p(token) = (count(context, token) + a * p0(token)) / (count(context) + a), p0 being the unigram
probability and a = STRENGTH / length(context)^2: longer contexts are trusted more.

A shard of more suffixes than SHARD_TOKENS (frequent pairs) is looked up in parts, whose counts add up.
All files are memory-mapped; nothing that grows is broadcast or collected.
"""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, fresh_path, local_path, written
from .suffix import Shard, gram_keys

#: Suffixes of one shard, and tokens of one file of the token store.
SHARD_TOKENS, UNIT_TOKENS = 2_500_000, 3_000_000
#: Tokens of a unit that are scored at once.
PIECE_TOKENS = 1 << 18
#: Files of tokens end at multiples of so many, so that they can be mapped one behind another.
ALIGN = 1 << 14
STRENGTH = 100.0
#: The end token's hash; no word has a space.
END = xxhash.xxh64_intdigest(b" end", 42)


def token_hashes(text: str | None) -> np.ndarray:
    """The words' hashes, ASCII letters in lower case, and the end token's."""
    h = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().lower().split()]
    h.append(END)
    return np.array(h, np.uint64).view(np.int64)


class _Store:
    """Writes texts' tokens: one file for a unit, training texts before held-out ones."""

    def __init__(self, folder: str):
        self.folder, self.kind = folder, {}
        os.makedirs(folder, exist_ok=True)
        self.clear()

    def clear(self) -> None:
        self.texts: tuple[list, list] = ([], [])
        self.ids: tuple[list, list] = ([], [])
        self.tokens = 0

    def add(self, i, held: bool, h: np.ndarray) -> None:
        self.texts[held].append(h)
        self.ids[held].append(i)
        self.tokens += len(h)

    def flush(self) -> tuple:
        """(unit, ids, lengths, n_train, train_texts) and the counts of the training tokens."""
        none = np.zeros(0, np.int64)
        train, held = (np.concatenate(x) if x else none for x in self.texts)
        unit = uuid.uuid4().hex
        save(f"{self.folder}/{unit}.words", np.concatenate([train, held]))
        lengths = [len(h) for h in self.texts[1]]
        first = [first_of(x) for x in self.texts]
        save(f"{self.folder}/{unit}.first", np.concatenate([first[0], first[1] + len(first[0])]).astype(np.int32))
        words, counts = np.unique(train, return_counts=True)
        row = (unit, self.ids[0] + self.ids[1], [len(h) for h in self.texts[0]] + lengths, len(train), len(self.texts[0]))
        self.clear()
        return row, words, counts


def save(path: str, a: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    a.tofile(part)
    os.replace(part, path)


def mapped(path: str, kind) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def starts_of(lengths) -> tuple[np.ndarray, np.ndarray]:
    """(place, tokens left in the text) of all tokens of texts that lie one behind another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(int(lengths.sum()))
    return at, ends - at


def first_of(texts: list[np.ndarray]) -> np.ndarray:
    """For each text the first of those equal to it."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(h.tobytes(), i) for i, h in enumerate(texts)], np.int64)


def queries_of(lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts_of() without texts that an equal one precedes and without last tokens."""
    at, room = starts_of(lengths)
    use = (room >= 2) & np.repeat(first == np.arange(len(first)), lengths)
    return at[use], room[use]


class Vocabulary:
    """Counts of training tokens from the sorted files that vocabulary() wrote."""

    def __init__(self, manifest: str):
        t = pq.read_table(manifest).to_pydict()
        order = np.argsort(np.array(t["first"], np.int64))
        self.paths = [t["path"][i] for i in order]
        self.first = np.array(t["first"], np.int64)[order]
        self.total, self.distinct = sum(t["total"]), sum(t["distinct"])
        self.before = np.concatenate([[0], np.cumsum(np.array(t["distinct"], np.int64)[order])])
        self.open: dict[int, tuple] = {}

    def _files(self, k: int) -> tuple:
        if k not in self.open:
            self.open[k] = mapped(self.paths[k] + ".words", np.int64), mapped(self.paths[k] + ".counts", np.int64)
        return self.open[k]

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        """The place in the vocabulary of each of some sorted distinct tokens, -1 for unknown ones."""
        out = np.full(len(tokens), -1, np.int64)
        if not len(self.first):
            return out
        cut = np.append(np.searchsorted(tokens, self.first[1:]), len(tokens))
        at = 0
        for k, end in enumerate(cut.tolist()):
            if end > at:
                words = self._files(k)[0]
                part = tokens[at:end]
                p = np.minimum(np.searchsorted(words, part), len(words) - 1)
                out[at:end] = np.where(words[p] == part, p + self.before[k], -1)
            at = end
        return out

    def count(self, ids: np.ndarray) -> np.ndarray:
        """The count of each of some sorted places, 0 for those below 0."""
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, self.before)
        for k, (at, end) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if end > at:
                out[at:end] = self._files(k)[1][ids[at:end] - self.before[k]]
        return out


def tokenized(docs: DataFrame, folder: str, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Write the token store -> units (kind 0) and training counts (kind 1), as one table."""
    id_type = dict(docs.dtypes)[id_col]
    schema = f"kind int, unit string, ids array<{id_type}>, lengths array<long>, n_train long, train_texts long, words array<long>, counts array<long>"

    def run(batches):
        store = _Store(folder)
        ids_type = None

        def rows():
            unit, words, counts = store.flush()
            step = 1 << 16
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([unit[0]]), pa.array([unit[1]], pa.list_(ids_type)), pa.array([unit[2]], pa.list_(pa.int64())), pa.array([unit[3]], pa.int64()), pa.array([unit[4]], pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))], names=names)
            for s in range(0, len(words), step):
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(ids_type)), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([words[s : s + step]], pa.list_(pa.int64())), pa.array([counts[s : s + step]], pa.list_(pa.int64()))], names=names)

        names = ["kind", "unit", "ids", "lengths", "n_train", "train_texts", "words", "counts"]
        for b in batches:
            ids_type = b.schema.field(0).type
            for i, h, text in zip(*(c.to_pylist() for c in b.columns)):
                store.add(i, bool(h), token_hashes(text))
                if store.tokens >= UNIT_TOKENS:
                    yield from rows()
        if store.tokens:
            yield from rows()

    return docs.select(docs[id_col].alias("id"), held.alias("held"), docs[text_col].alias("text")).mapInArrow(run, schema)


def vocabulary(counts: DataFrame, folder: str) -> DataFrame:
    """counts(words, counts) -> the files of the vocabulary, sorted, by range: (path, first, distinct, total)."""
    flat = counts.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))
    flat = written(flat, "counts")

    def run(batches):
        batches = list(batches)  # one range of the vocabulary, 16 bytes a word
        if not sum(b.num_rows for b in batches):
            return
        words, n = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1))
        path = f"{folder}/{uuid.uuid4().hex}"
        save(path + ".words", words)
        save(path + ".counts", n)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(words[0])], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["path", "first", "distinct", "total"])

    return flat.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, "path string, first long, distinct long, total long")


def shard_keys(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By these a place's first two tokens decide its shard."""
    return gram_keys(t, at, 2) * np.uint64(0xD6E8FEB86659FD93)


def encode_unit(folder: str, unit: str, lengths: np.ndarray, n_train: int, texts: int, vocabulary: Vocabulary, shards: int) -> int:
    """Replace a unit's hashes by a file of places in the vocabulary, and write which of them belong to each shard -> tokens in the file."""
    size = -(-int(lengths.sum()) // ALIGN) * ALIGN
    raw = f"{folder}/{unit}.words"
    if not os.path.exists(raw):  # an earlier attempt came to the end
        return size
    words, back = np.unique(np.fromfile(raw, np.int64), return_inverse=True)
    t = vocabulary.ids(words).astype(np.int32)[back.ravel()]
    first = np.array(mapped(f"{folder}/{unit}.first", np.int32), np.int64)
    ends = np.cumsum(lengths)
    own = (first[:texts] == np.arange(texts)) & (lengths[:texts] >= 2)
    at, _ = queries_of(lengths[texts:], first[texts:] - texts)
    asked = np.concatenate([(ends - lengths)[:texts][own], at + n_train])
    asked = asked[(t[asked] >= 0) & (t[asked + 1] >= 0)] if len(asked) else asked
    suffixes = np.delete(np.arange(n_train), ends[:texts] - 1)
    bounds = np.array([(i << 64) // shards for i in range(shards)], np.uint64)
    for kind, places in (("asked", asked), ("suffixes", suffixes)):
        k = shard_keys(t, places)
        by = np.argsort(k)
        save(f"{folder}/{unit}.{kind}", places[by].astype(np.int32))
        save(f"{folder}/{unit}.{kind}-cuts", np.append(np.searchsorted(k[by], bounds), len(k)))
    save(f"{folder}/{unit}.ends", ends)
    save(f"{folder}/{unit}.tokens", np.append(t, np.full(size - len(t), t[-1])))
    os.remove(raw)
    return size


def row_of(paths: list[str], sizes: list[int]) -> tuple[np.ndarray, callable]:
    """Files of 32-bit numbers, mapped one behind another as one array, and what ends that."""
    libc = ctypes.CDLL(None, use_errno=True)
    libc.mmap.restype = ctypes.c_void_p
    libc.mmap.argtypes = [ctypes.c_void_p, ctypes.c_size_t, ctypes.c_int, ctypes.c_int, ctypes.c_int, ctypes.c_long]
    libc.munmap.argtypes = [ctypes.c_void_p, ctypes.c_size_t]

    def at(*args) -> int:
        x = libc.mmap(*args)
        if x == ctypes.c_void_p(-1).value:
            raise OSError(ctypes.get_errno(), os.strerror(ctypes.get_errno()))
        return x

    none, shared, private, fixed, anonymous = 0, 1, 2, 0x10, 0x20
    total = sum(sizes)
    base = here = at(None, 4 * total, none, private | anonymous, -1, 0)
    for path, size in zip(paths, sizes):
        fd = os.open(path, os.O_RDONLY)
        at(here, 4 * size, 1, shared | fixed, fd, 0)
        os.close(fd)
        here += 4 * size
    return np.frombuffer((ctypes.c_int32 * total).from_address(base), np.int32), lambda: libc.munmap(base, 4 * total)


def _search(folder: str, encoded_path: str):
    """Numbers of shards -> for each unit of the store the drops() of its places in the shard: (unit, blob)."""

    def run(batches):
        numbers = [x for b in batches for x in b.column(0).to_pylist()]
        if not numbers:
            return
        rows = pq.read_table(encoded_path).sort_by("unit").to_pydict()
        units, sizes = rows["unit"], rows["size"]
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        t, close = row_of([f"{folder}/{u}.tokens" for u in units], sizes)
        squeeze = zstandard.ZstdCompressor(level=1)

        def gathered(kind: str, number: int) -> tuple[np.ndarray, np.ndarray]:
            """(place in t, tokens left in its text)"""
            places, room = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for u, b in zip(units, base.tolist()):
                s, e = mapped(f"{folder}/{u}.{kind}-cuts", np.int64)[number : number + 2].tolist()
                if e > s:
                    x = mapped(f"{folder}/{u}.{kind}", np.int32)[s:e].astype(np.int64)
                    ends = mapped(f"{folder}/{u}.ends", np.int64)
                    room.append(ends[np.searchsorted(ends, x, side="right")] - x)
                    places.append(x + b)
            return np.concatenate(places), np.concatenate(room)

        for number in numbers:
            places, room = gathered("suffixes", number)
            at, left_in = gathered("asked", number)
            left = t[at - 1].astype(np.int64)
            left[left == t[-1]] = -2
            who, length, n = drops_of(t, places, room, at, left_in, left)
            of = np.searchsorted(base, at[who], side="right") - 1
            by = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[by], np.arange(len(units) + 1)).tolist()
            for i, (s, e) in enumerate(zip(cut, cut[1:])):
                if e > s:
                    own = by[s:e]
                    blob = squeeze.compress(packed(at[who[own]] - base[i], length[own], n[own]))
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([units[i]]), pa.array([blob], pa.binary())], names=["kind", "unit", "blob"])
        del t
        close()

    return run


def drops_of(t: np.ndarray, places: np.ndarray, room: np.ndarray, at: np.ndarray, left_in: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shard.drops() of the suffixes at some places, in parts where they are too many for one.

    In a part the longest match may not be the longest, so which places are left out is found in all parts first.
    """
    parts = max(1, -(-len(places) // (2 * SHARD_TOKENS)))
    shards = [(places[i::parts], room[i::parts]) for i in range(parts)]
    which = np.arange(len(at))
    if parts > 1:
        most, seen = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        for own in shards:
            here, beside = Shard.around(t, *own, at, left_in).longest(at, left_in, left)
            seen = np.where(here == most, seen | beside, np.where(here > most, beside, seen))
            most = np.maximum(most, here)
        which = np.flatnonzero(~seen)
        at, left_in, left = at[which], left_in[which], None
    who, length, n = (np.concatenate(x) for x in zip(*(Shard.around(t, *own, at, left_in).drops(t, at, left_in, left=left) for own in shards)))
    return which[who], length, n


def packed(at: np.ndarray, length: np.ndarray, n: np.ndarray) -> bytes:
    """drops() in order of places, which are written as steps; each byte of the numbers in a row of its own, so that it compresses."""
    by = np.lexsort((length, at))
    rows = np.stack([np.diff(at[by], prepend=0), length[by], n[by]]).astype("<i4")
    return np.ascontiguousarray(rows.view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1)).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    """What packed() wrote: places, lengths and counts."""
    rows = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(3, 4, -1).transpose(0, 2, 1)).view("<i4").reshape(3, -1).astype(np.int64)
    rows[0] = np.cumsum(rows[0])
    return rows


class Drops:
    """Summed drops of all shards for one unit: how often the tokens from a place occur in the training texts."""

    def __init__(self, parts: list[np.ndarray]):
        at, length, n = (np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(3))
        self.key, back = np.unique(at << 32 | length, return_inverse=True)
        n = np.bincount(back.ravel(), n, len(self.key)).astype(np.int64)
        self.upto = np.concatenate([[0], np.cumsum(n)])
        self.at = self.key >> 32

    def packed(self) -> np.ndarray:
        return np.stack([self.at, self.key & 0xFFFFFFFF, np.diff(self.upto)])

    def occurs(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How often the `length` tokens (two or more) from each place occur."""
        first = np.searchsorted(self.key, at << 32 | length)
        end = np.searchsorted(self.at, at, side="right")
        return self.upto[np.maximum(first, end)] - self.upto[first]

    def within(self, start: int, end: int) -> Drops:
        """Those of the places from start to before end, counted from start."""
        a, b = np.searchsorted(self.at, [start, end]).tolist()
        part = Drops.__new__(Drops)
        part.key, part.upto, part.at = self.key[a:b] - (start << 32), self.upto[a : b + 1] - self.upto[a], self.at[a:b] - start
        return part

    def longest(self, size: int) -> np.ndarray:
        """The longest match from each of `size` places, 0 where none of two tokens."""
        out = np.zeros(size, np.int64)
        np.maximum.at(out, self.at, self.key & 0xFFFFFFFF)
        return out


def pieces(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole texts, each of about PIECE_TOKENS or one text: (first, end)."""
    of = (np.cumsum(lengths) - 1) // PIECE_TOKENS
    cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(lengths)]
    return list(zip(cut, cut[1:]))


def score_unit(t: np.ndarray, lengths: np.ndarray, texts: int, drops: Drops, vocabulary: Vocabulary | None) -> tuple[np.ndarray, ...]:
    """(n_known, base, score) of each text of a unit, piece by piece, for the memory."""
    out, ends = [], np.append(0, np.cumsum(lengths))
    for i, j in pieces(lengths):
        s, e = int(ends[i]), int(ends[j])
        words, back = np.unique(t[s:e], return_inverse=True)
        count = vocabulary.count(words)[back.ravel()] if vocabulary else np.zeros(e - s, np.int64)
        total, distinct = (vocabulary.total, vocabulary.distinct) if vocabulary else (0, 0)
        out.append(score_texts(t[s:e], lengths[i:j], min(max(texts - i, 0), j - i), drops.within(s, e), count, total, distinct))
    return tuple(np.concatenate(x) for x in zip(*out))


def score_texts(t: np.ndarray, lengths: np.ndarray, texts: int, drops: Drops, count: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, ...]:
    """(n_known, base, score) of each of some texts, the first of which are training texts; count: of each token in all training texts."""
    p0 = (count + 0.5) / (total + 0.5 * (distinct + 1))
    at, room = starts_of(lengths)
    head = at + room - np.repeat(lengths, lengths)
    begin = head.copy()
    n_train = int(lengths[:texts].sum())
    # held-out texts: the first place whose match reaches up to a token starts its longest context
    if len(at) > n_train:
        reach = drops.longest(len(t))[n_train:]
        own = at[n_train:]
        ends = own + np.maximum(reach, (count[n_train:] > 0).astype(np.int64))
        ends = np.maximum.accumulate(ends)
        begin[n_train:] = np.maximum(np.searchsorted(ends, own) + n_train, head[n_train:])
    length = at - begin
    have = length > 0
    context = np.zeros(len(t), np.int64)
    one = length == 1
    context[one] = count[at[one] - 1]
    more = length > 1
    context[more] = drops.occurs(begin[more], length[more])
    follows = np.zeros(len(t), np.int64)
    follows[have] = drops.occurs(begin[have], length[have] + 1)
    a = STRENGTH / np.maximum(length, 1) ** 2
    p = np.where(have & (context > 0), (follows + a * p0) / (context + a), p0)
    cut = np.cumsum(lengths) - lengths
    add = lambda x: np.add.reduceat(x, cut)
    return add((count > 0).astype(np.int64)), add(np.log10(p0)), add(np.log10(p))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_fold: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Rows whose id's fold is held_fold are held out, the others are learnt from; a null id counts as
    the empty text. Null texts are empty and have the end token alone. Repeated rows are learnt from
    and scored as often as they come. Extra columns aren't read. An empty table gives an empty
    result. Without training texts every token has the unknown token's probability. Texts are taken
    whole; contexts have no bound. The shared folder must be mounted on every executor.
    """
    spark = docs.sparkSession
    folder = local_path(fresh_path(spark, "tokens"))
    id_type = dict(docs.dtypes)[id_col]
    both = written(tokenized(docs, folder, id_col, text_col, doc_fold(docs[id_col]) == held_fold), "units")
    units = written(both.where("kind = 0").select("unit", "ids", "lengths", "n_train", "train_texts"), "units")
    manifest = written(vocabulary(both.where("kind = 1").select("words", "counts"), folder), "vocabulary")
    of = lambda x: local_path(x.inputFiles()[0].rpartition("/")[0]) if x.inputFiles() else ""
    manifest_path = of(manifest)
    total = manifest.agg(F.sum("total")).first()[0] or 0
    shards = -(-total // SHARD_TOKENS)

    def encode(batches):
        vocabulary = Vocabulary(manifest_path)
        for b in batches:
            for i in range(b.num_rows):
                unit, n_train, texts = (b.column(c)[i].as_py() for c in (0, 2, 3))
                size = encode_unit(folder, unit, b.column(1)[i].values.to_numpy(), n_train, texts, vocabulary, shards)
                yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([size], pa.int64())], names=["unit", "size"])

    # without training texts there is nothing to look up, and the hashes stay as they are
    found = spark.createDataFrame([], "kind int, unit string, blob binary")
    if shards:
        encoded = written(units.select("unit", "lengths", "n_train", "train_texts").repartition(max(12, shards), "unit").mapInArrow(encode, "unit string, size long"), "encoded")
        work = spark.range(0, shards, 1, shards)
        found = work.mapInArrow(_search(folder, of(encoded)), "kind int, unit string, blob binary")
    whole = units.select(F.lit(0).alias("kind"), "unit", F.lit(None).cast("binary").alias("blob"), "ids", "lengths", "train_texts")
    found = found.select("kind", "unit", "blob", *(F.lit(None).cast(whole.schema[c].dataType).alias(c) for c in ("ids", "lengths", "train_texts")))
    together = whole.union(found).repartition("unit").sortWithinPartitions("unit", "kind")

    def run(batches):
        vocabulary = Vocabulary(manifest_path) if manifest_path else None
        expand = zstandard.ZstdDecompressor()
        now, parts = None, []

        def close():
            unit, ids, lengths, texts = now
            t = mapped(f"{folder}/{unit}.tokens", np.int32) if shards else np.full(int(lengths.sum()), -1, np.int32)
            first = mapped(f"{folder}/{unit}.first", np.int32)
            known, base, score = (x[first] for x in score_unit(t, lengths, texts, Drops(parts), vocabulary))
            total = vocabulary.total if vocabulary else 0
            held = np.arange(len(lengths)) >= texts
            for s in range(0, len(lengths), 10_000):
                e = min(s + 10_000, len(lengths))
                yield pa.RecordBatch.from_arrays([ids[s:e], pa.array(held[s:e]), pa.array(lengths[s:e]), pa.array(known[s:e]), pa.array(np.full(e - s, total, np.int64)), pa.array(base[s:e]), pa.array(score[s:e])], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() == 0:
                    if now:
                        yield from close()
                    now = b.column(1)[i].as_py(), b.column(3)[i].values, b.column(4)[i].values.to_numpy(), b.column(5)[i].as_py()
                    parts = []
                else:
                    parts.append(unpacked(expand.decompress(b.column(2)[i].as_py())))
                    if sum(p.shape[1] for p in parts[1:]) > 4 << 20:  # fold many shards into one
                        parts = [Drops(parts).packed()]
        if now:
            yield from close()

    schema = f"{id_col} {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.mapInArrow(run, schema)
