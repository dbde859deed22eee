"""Near copies: links that connect just what pairs with a Jaccard similarity of 0.8 or more of their five-word shingles connect.

A set of n shingles can have that similarity only with sets that hold 4/5 of it, so two such sets share
a shingle among the first n - ceil(4n/5) + 1 of each in any one order (a prefix filter), and near a tenth
of each set there. The order here puts shingles last that are frequent in a sample, which only saves
candidates. A group of m near copies would make m^2 / 2 pairs, so the search has three steps: pairs of
each set with its neighbours under its first keys are counted on whole sets and those that hold make
classes; under all keys only pairs in different classes come up, of which each set's best is counted; then
those that are still in different classes. So every link between two classes is looked at.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_lists, written
from .components import connected_components

SIZE = 5
#: Sets in the sample for the order, its bound on frequent shingles and their least count.
SAMPLE, FREQUENT, LEAST = 8_000, 65_536, 8
#: Under so many of its first keys a set is paired with its neighbours in the first step.
FIRST = 3
#: Sets that are looked up by a broadcast of their rows' numbers; more are joined.
BROADCAST = 200_000
#: Bytes of a shingle's hash by which candidates are counted.
KEPT = 5
#: Texts, and pairs of sets, that a task holds at once.
TEXT_ROWS, PAIR_ROWS = 1000, 200
#: Pairs that are looked at together, and rows of a key that go row by row.
_PAIRS, _SMALL = 1 << 20, 256


def hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """Hashes of the word shingles, repeats included; the whole text is one where it has fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(hashes(text, size).view(np.int64))


def majority(h: np.ndarray) -> int:
    """The SimHash of some hashes: each bit that over half of them have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def node_of(grams: np.ndarray) -> int:
    """The name of a set: equal sets have the same."""
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def nodes(rows: DataFrame) -> DataFrame:
    """rows(id, row LONG, text) -> (id, row, node LONG, n INT, fp LONG): the name and the size of each row's set, and its SimHash."""

    def make():
        def one(text):
            h = hashes(text)
            s = np.unique(h.view(np.int64))
            return node_of(s), len(s), majority(h)

        def run(ids, row, texts):
            names, sizes, fps = zip(*map(one, texts)) if texts else ((), (), ())
            return ids, row, names, sizes, pa.array(np.array(fps, np.uint64).view(np.int64))

        return run

    return map_lists(rows.select("id", "row", "text"), make, f"id {dict(rows.dtypes)['id']}, row long, node long, n int, fp long")


def frequent(rows: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count), sorted, of shingles that many sets of a sample hold; at most FREQUENT."""
    every = max(1, -(-count // SAMPLE))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()

    def explode(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["g"])

    seen = some.mapInArrow(explode, "g long").groupBy("g").count().where(F.col("count") >= LEAST)
    found = seen.orderBy(F.desc("count"), "g").limit(FREQUENT).collect()
    g, c = np.array([r["g"] for r in found], np.int64), np.array([r["count"] for r in found], np.int64)
    order = np.argsort(g)
    return g[order], c[order]


def prefix(grams: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set, one of which every set with a similarity of 0.8 has in its own prefix."""
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        grams = grams[np.argsort(np.where(known[at] == grams, count[at], 0), kind="stable")]
    return grams[: len(grams) - -(-4 * len(grams) // 5) + 1] if len(grams) else grams


def keys(rows: DataFrame, known: np.ndarray, count: np.ndarray) -> DataFrame:
    """(key, node, place LONG): the prefix of each set; place holds its place (high 32 bits) and the set's size."""

    def expand(batches):
        seen: set[int] = set()  # copies in one task are left out, as many as the bound allows
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                grams = shingles(text)
                node = node_of(grams)
                if node in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(node)
                p = prefix(grams, known, count)
                out.append((p, np.full(len(p), node), np.arange(len(p)) << 32 | len(grams)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "node", "place"])

    return rows.select("text").mapInArrow(expand, "key long, node long, place long")


def _runs(batches):
    """Sorted batches -> the same rows as arrays, cut so that no key's rows are apart."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        if held and held[0][0][0] == cols[0][-1]:
            held.append(cols)
            continue
        cols = [np.concatenate(x) for x in zip(*held, cols)]
        cut = np.searchsorted(cols[0], cols[0][-1])
        if cut:
            yield [c[:cut] for c in cols]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def possible(i, j, n, at) -> np.ndarray:
    """Whether sizes and places under one key allow rows i and j to be near copies."""
    most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
    return 9 * most >= 4 * (n[i] + n[j])


_SHARED = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("place", pa.int64()), ("other", pa.int64())])


def _shared(batches):
    """Rows (key, place, node), sorted -> the rows of keys that several sets have, and, in other, neighbours to compare.

    A row names the one before it and, in a row without key, the first of its key among the rows that
    have the key in front.
    """
    for key, node, place in _runs(batches):
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, place = key[new], node[new], place[new]
        more = np.append(False, key[1:] == key[:-1])
        more |= np.append(more[1:], False)
        key, node, place = key[more], node[more], place[more]
        if not len(key):
            continue
        n, at = place & 0xFFFFFFFF, place >> 32
        front = np.flatnonzero(at < FIRST)
        k = key[front]
        first = front[np.searchsorted(k, k)]
        before = np.roll(front, 1)
        ok = k == np.roll(k, 1)
        ok[:1] = False
        j = front[ok]
        out = []
        for i in (before[ok], first[ok]):
            use = possible(i, j, n, at) & (node[i] != node[j])
            out.append((node[i[use]], node[j[use]]))
        a, b = (np.concatenate(x) for x in zip(*out))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(place), pa.nulls(len(key), pa.int64())], schema=_SHARED)
        yield pa.RecordBatch.from_arrays([pa.nulls(pair.shape[1], pa.int64()), pa.array(pair[0]), pa.nulls(pair.shape[1], pa.int64()), pa.array(pair[1])], schema=_SHARED)


def _small(key, n, at, of):
    """Possible pairs of rows, sorted by key and n, of one key and of different labels; row by row and distance by distance."""
    i, d = np.arange(len(key)), 1
    while len(i):
        i = i[i + d < len(key)]
        j = i + d
        same = (key[i] == key[j]) & (4 * n[j] <= 5 * n[i])
        i, j = i[same], j[same]
        use = (of[i] != of[j]) & possible(i, j, n, at)
        yield i[use], j[use]
        d += 1


def _large(n, at, of):
    """The same for the rows of one key, sorted by n: the largest class needs no row of its own, its pairs come from the others' rows."""
    _, of, size = np.unique(of, return_inverse=True, return_counts=True)
    own = np.flatnonzero(of != np.argmax(size))
    first = np.searchsorted(5 * n, 4 * n[own])
    c = np.searchsorted(4 * n, 5 * n[own], side="right") - first
    many = np.cumsum(c)
    for part in np.split(np.arange(len(own)), np.searchsorted(many, np.arange(_PAIRS, int(c.sum()), _PAIRS))):
        i = np.repeat(own[part], c[part])
        j = np.arange(len(i)) - np.repeat(np.cumsum(c[part]) - c[part], c[part]) + np.repeat(first[part], c[part])
        use = (of[i] != of[j]) & possible(i, j, n, at)
        yield i[use], j[use]


def _across(batches):
    """Rows (key, node, place, label), sorted by key -> possible pairs (a, b) of one key and of different labels, their sizes and under how many keys they came."""
    held: list[np.ndarray] = []

    def batch():
        x = np.concatenate(held, axis=1)
        x = x[:, np.lexsort((x[1], x[0]))]
        new = np.flatnonzero(np.append(True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])))
        count = np.diff(np.append(new, x.shape[1]))
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in x[:, new]), pa.array(count)], names=["a", "b", "n_a", "n_b", "common"])

    def found(key, n, at, of):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        mixed = np.minimum.reduceat(of, start) < np.maximum.reduceat(of, start)
        few = np.flatnonzero(np.repeat(mixed & (size <= _SMALL), size))
        for i, j in _small(*(x[few] for x in (key, n, at, of))):
            yield few[i], few[j]
        for s, c in zip(start[mixed & (size > _SMALL)].tolist(), size[mixed & (size > _SMALL)].tolist()):
            for i, j in _large(*(x[s : s + c] for x in (n, at, of))):
                yield i + s, j + s

    for key, name, place, of in _runs(batches):
        n, at = place & 0xFFFFFFFF, place >> 32
        by = np.lexsort((n, key))
        key, name, n, at, of = (x[by] for x in (key, name, n, at, of))
        for i, j in found(key, n, at, of):
            swap = name[i] > name[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                held.append(np.stack([name[i], name[j], n[i], n[j]]))
            if sum(x.shape[1] for x in held) > _PAIRS // 2:
                yield batch()
                held = []
    if held:
        yield batch()


def _pack(grams: np.ndarray) -> bytes:
    """A set's hashes, cut to KEPT bytes, sorted: what candidates are counted by."""
    return np.ascontiguousarray(np.sort(grams.view(np.uint64) >> np.uint64(64 - 8 * KEPT)).view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(b, np.uint8).reshape(-1, KEPT)
    return out.view(np.uint64).ravel()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more: 9 times the common ones are 4 times both sizes."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)


def counted(pairs: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """pairs(a, b), written -> those of them, written, that are near copies, counted on whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    where = written(named.join(wanted, "node").groupBy("node").agg(F.min("row").alias("row")), "near-rows")
    if where.count() <= BROADCAST:
        where = F.broadcast(where)
    texts = rows.select("row", "text").join(where, "row").select("node", "text")

    def make():
        return lambda node, text: (node, [_pack(shingles(t)) for t in text])

    sets = map_lists(texts, make, "node long, grams binary")
    with arrow_batches(rows.sparkSession, TEXT_ROWS):
        sets = written(sets, "near-sets")
    end = lambda x: sets.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}"))
    both = pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").select("a", "b", "grams_a", "grams_b")

    def run(batches):
        for b in batches:
            a, c, x, y = (b.column(i) for i in range(4))
            use = [similar(_unpack(p), _unpack(q)) for p, q in zip(x.to_pylist(), y.to_pylist())]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(use, pa.bool_())), c.filter(pa.array(use, pa.bool_()))], names=["a", "b"])

    with arrow_batches(rows.sparkSession, PAIR_ROWS):
        return written(both.mapInArrow(run, "a long, b long"), "near-links")


def links(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows(row, text), numbered alike in every plan, and named as of nodes(), written -> edges (a, b) between nodes.

    Each edge is a pair of near copies, and whatever two near copies are, edges connect them.
    """
    known, count = frequent(rows, named.count())
    spread = keys(rows, known, count).repartition("key").sortWithinPartitions("key", F.expr("place & 4294967295"), "node")
    with arrow_batches(rows.sparkSession, TEXT_ROWS):
        shared = written(spread.mapInArrow(_shared, "key long, node long, place long, other long"), "near-keys")
    first = written(shared.where("key is null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "near-pairs")
    held = counted(first, rows, named)
    label = lambda df, x, of: df.join(of.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    keyed = label(shared.where("key is not null").select("key", "node", "place"), "node", written(connected_components(held), "near-classes"))
    keyed = keyed.select("key", "node", "place", "root_node")
    pairs = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_across, "a long, b long, n_a long, n_b long, common long")
    pairs = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    # what near copies have in common beyond both prefixes is at most the rest of the one whose prefix ends first
    rest = F.ceil(F.greatest("n_a", "n_b") * 4 / 5) - 1
    pairs = pairs.where((F.col("common") + rest) * 9 >= (F.col("n_a") + F.col("n_b")) * 4)
    pairs = written(pairs.join(first, ["a", "b"], "left_anti"), "near-pairs")
    # each set with the one that it has most in common with, then what is left between classes
    share = F.col("common") / F.greatest("n_a", "n_b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")
    best = pairs.select(ends, share.alias("share")).groupBy("e.node").agg(F.max_by("e.other", F.struct("share", "e.other")).alias("other"))
    best = written(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "near-pairs")
    held = held.union(counted(best, rows, named))
    classes = written(connected_components(held), "near-classes")
    left = label(label(pairs.select("a", "b"), "a", classes), "b", classes).where(F.col("root_a") != F.col("root_b"))
    left = written(left.select("a", "b").join(best, ["a", "b"], "left_anti"), "near-pairs")
    return held.union(counted(left, rows, named))
