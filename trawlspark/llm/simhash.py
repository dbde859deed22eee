"""SimHash near-dedup: Golay keys of fingerprint segments find all pairs within three bits.

A fingerprint of 64 bits is cut into five segments. Three differing bits leave at least two segments
equal and, for a fixed third segment of some such two, at most one differing bit. So two segments
taken exactly and the Golay codeword indices near a third (one to six of them) make keys of 38 bits,
about 53 for each fingerprint, of which two fingerprints within three bits always share one.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import arrow_batches, map_lists, numberable, written
from .components import connected_components
from .golay import key_table

WIDTHS = (13, 13, 13, 13, 12)
MAX_BITS = 3
#: A key that more distinct fingerprints share is split by further exact bits.
HOT = 4096


@cache
def plan() -> list[tuple[int, int, int]]:
    """(p, q, r): segments p and q exact, r by Golay indices; every spread of three errors is met."""
    pairs = list(combinations(range(5), 2))
    spreads = [e for e in product(range(MAX_BITS + 1), repeat=5) if sum(e) <= MAX_BITS]
    for third in product(*([x for x in range(5) if x not in pq] for pq in pairs)):
        chosen = [(p, q, r) for (p, q), r in zip(pairs, third)]
        if all(any(e[p] == 0 and e[q] == 0 and e[r] <= 1 for p, q, r in chosen) for e in spreads):
            return chosen
    raise AssertionError("no plan")


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles; 0 for a null text and one without words."""
    return near_copies.majority(near_copies.hashes(text, size))


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp LONG) of each row; the same 64 bits, signed."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        return lambda ids, texts: (ids, _signed([fingerprint(t, size) for t in texts]))

    return map_lists(docs.select(docs[id_col], docs[text_col]), make, f"id {kind}, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for w in WIDTHS:
        out.append((fp >> np.uint64(at)).astype(np.int64) & ((1 << w) - 1))
        at += w
    return out


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of each fingerprint."""
    seg, keys, rows = _segments(fp), [], []
    for i, (p, q, r) in enumerate(plan()):
        k, starts = key_table(WIDTHS[r])
        first, n = starts[seg[r]], starts[seg[r] + 1] - starts[seg[r]]
        row = np.repeat(np.arange(len(fp)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        exact = (i << 26 | seg[p] << 13 | seg[q])[row]
        keys.append(exact << 12 | k[at])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _finer(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that split a hot key: of four pieces of the two free segments, at most three differ."""
    p, q, r = plan()[key >> 38]
    a, b = (x for x in range(5) if x not in (p, q, r))
    seg = _segments(fp)
    pieces = [seg[a] & 63, seg[a] >> 6, seg[b] & 63, seg[b] >> 6]
    out = [np.int64(key) | np.int64(j) << 42 | x.astype(np.int64) << 44 for j, x in enumerate(pieces)]
    return np.concatenate(out), np.tile(fp, 4)


def tree_edges(fp: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within a bits among some distinct fingerprints."""
    left, a, b = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                queue.extend(found)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def _linker(split_hot: bool):
    """Rows sorted by key -> kind 0: an edge (a, b); kind 1: a finer key and a fingerprint of a hot key."""

    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def batch(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def run(batches):
        key, held, hot = None, [], False

        def close():
            fp = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            if len(fp) > 1:
                a, b = tree_edges(fp)
                if len(a):
                    yield batch(0, a, b)

        for b in batches:
            k, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(k)) + 1
            ends = np.append(cuts, len(k))
            starts = np.concatenate([[0], cuts])
            # runs of one row inside the batch link nothing
            for s, e in zip(*(x[(ends - starts > 1) | (starts == 0) | (ends == len(k))] for x in (starts, ends))):
                if k[s] != key:
                    yield from close()
                    key, held, hot = k[s], [], False
                held.append(fp[s:e])
                if split_hot and (hot or sum(map(len, held)) > HOT):
                    hot = True
                    yield batch(1, *_finer(int(key), np.concatenate(held)))
                    held = []
        yield from close()

    return run


def links(fps: DataFrame) -> DataFrame:
    """fps(fp LONG, distinct) -> edges (a, b) of a forest that links exactly what links within three bits reach."""

    def expand(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 4096):
                k, row = keys_of(fp[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[i : i + 4096][row].view(np.int64))], names=["key", "fp"])

    def joined(keys, split_hot):
        near = keys.repartition("key").sortWithinPartitions("key")
        return near.mapInArrow(_linker(split_hot), "kind int, a long, b long")

    found = written(joined(fps.select("fp").mapInArrow(expand, "key long, fp long"), True), "simhash-links")
    hot = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    more = joined(hot, False)
    return found.where("kind = 0").union(more).select("a", "b")


def _components(at: DataFrame, key: str, edges) -> DataFrame:
    """(id, key, root, component_id) of each row of at(id, key); edges: a function of the nodes."""
    nodes = at.groupBy(key).agg(F.min("id").alias("least"))
    roots = connected_components(edges(nodes)).withColumnsRenamed({"node": key})
    named = nodes.join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.select(key, "root").join(whole, "root")
    return at.join(known, key).select("id", key, "root", "component_id")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs, whose rows are numbered alike in every plan, and (id, row, text): id sorts nulls last and ties by row."""
    docs = numberable(docs)
    row = F.monotonically_increasing_id()
    at = F.struct(docs[id_col].isNull().alias("n"), docs[id_col].alias("i"), row.alias("row"))
    return docs, docs.select(at.alias("id"), row.alias("row"), docs[text_col].alias("text"))


def _near_copies(rows: DataFrame) -> DataFrame:
    """rows(id, row, text) -> (id, node, root, component_id): components of SimHash links and of near copies, see near_copies."""
    with arrow_batches(rows.sparkSession, near_copies.TEXT_ROWS):
        named = written(near_copies.nodes(rows), "near-nodes")
    return _components(named.select("id", "node"), "node", lambda _: _simhash_links(named).union(near_copies.links(rows, named)))


def _simhash_links(named: DataFrame) -> DataFrame:
    """named as of near_copies.nodes(), written -> edges (a, b) between nodes whose fingerprints are within MAX_BITS; the least node of a fingerprint stands for it."""
    least = written(named.groupBy("fp").agg(F.min("node").alias("b")), "near-fingerprints")
    same = named.select("node", "fp").join(least, "fp").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    of = lambda x: least.select(F.col("fp").alias(x), F.col("b").alias(f"node_{x}"))
    close = links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return same.union(close)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "shingles") -> DataFrame:
    """Components of near duplicates: of SimHash links and near copies, or of fingerprints that differ in at most three bits.

    by: "shingles" links documents whose SimHashes of five-word shingles are within MAX_BITS, and those
    whose sets of such shingles have a Jaccard similarity of 0.8 or more, which three bits mostly miss:
    all of both. "fingerprints" (the contract of op2) links those whose fp is within MAX_BITS.

    Returns for each row of docs: the id column (its name and type), fp LONG, root LONG (the least
    fingerprint of the component as signed, or the least name of its shingle sets) and component_id, the
    least id in the component. Nulls: a null text has fingerprint 0 and no shingles, linked as any other;
    a null id is never a component_id unless the component has no other. Repeated rows come back as often
    as they came. Equal fingerprints or sets are one node, so a group of copies is one row from the first
    aggregation on. Other columns, whatever their names, aren't read. An empty table gives an empty result.
    """
    if by not in ("shingles", "fingerprints"):
        raise ValueError(f"by: {by}")
    if by == "fingerprints":
        at = written(fingerprints(docs, id_col, text_col), "simhash")
        return _components(at, "fp", links).withColumnsRenamed({"id": id_col})
    docs, rows = _numbered(docs, id_col, text_col)
    fps = fingerprints(rows, "row", "text").withColumnsRenamed({"id": "row"})
    found = _near_copies(rows).withColumn("row", F.col("id.row")).join(fps, "row")
    return found.select(F.col("id.i").alias(id_col), "fp", "root", F.col("component_id.i").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates (SimHash links and near copies, see near_duplicates): of each component the row with the least id.

    Among equal ids, or where all are null, the first row in file order stays.
    """
    docs, rows = _numbered(docs, id_col, text_col)
    found = _near_copies(rows)
    name = "row"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    keep = found.groupBy("root").agg(F.min("id").alias("at")).select(F.col("at.row").alias(name))
    return docs.withColumn(name, F.monotonically_increasing_id()).join(keep, name, "left_semi").drop(name)
