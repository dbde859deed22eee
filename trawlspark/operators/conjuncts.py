"""Lists for conjuncts: words, AND, phrases, sloppy phrases and cutoffs as DataFrame operations on postings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .query import AND, PHRASE, WORD

SCHEMA = "qid string, cid int, type string, terms array<string>, f_qt int, slop int, cutoff int"


def sloppy_count(lists: list[list[int]], slop: int) -> list[int]:
    """Ends of a sloppy phrase's matches: positions, shifted to the phrase's end, within slop of the highest; greedy, each match moves past its highest."""
    at, out = [0] * len(lists), []
    while all(a < len(x) for a, x in zip(at, lists)):
        now = [x[a] for a, x in zip(at, lists)]
        high = now[0]
        equal = True
        for v in now:
            if v > high + slop:
                equal, high = False, v
            elif v < high - slop:
                equal = False
        if equal:
            out.append(high)
        bound = high + 1 if equal else high - slop
        moved = False
        for i, x in enumerate(lists):
            while at[i] < len(x) and x[at[i]] < bound:
                at[i] += 1
                moved = True
        if not moved:
            at[now.index(min(now))] += 1
    return out


def _sloppy(lists: DataFrame) -> DataFrame:
    """(qid, cid, docno, slop, parts: array<struct<i, ends>>) -> (qid, cid, docno, f_dt, first)."""

    def run(batches):
        for b in batches:
            n, first = [], []
            for slop, parts in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                ends = sloppy_count([p["ends"] for p in parts], slop)
                n.append(len(ends))
                first.append(ends[0] if ends else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int32()), pa.array(first, pa.int32())], names=["qid", "cid", "docno", "f_dt", "first"])

    return lists.mapInArrow(run, "qid string, cid int, docno long, f_dt int, first int").where("f_dt > 0")


def lists(postings: DataFrame, conjuncts: DataFrame, kinds: set[tuple[str, bool, bool]]) -> DataFrame:
    """(qid, cid, docno, f_dt) of each conjunct.

    kinds: the (type, sloppy, cutoff) that occur, so that the plan has no part that nothing needs: only
    words without a cutoff never read the offsets. The queries' side is small and broadcast; the
    postings are pruned to its terms before any shuffle.
    """
    out: list[DataFrame] = []
    small = lambda df: F.broadcast(df)

    def of(kind: str, sloppy: bool | None = None, cut: bool | None = None) -> DataFrame:
        c = conjuncts.where(F.col("type") == kind)
        if sloppy is not None:
            c = c.where((F.col("slop") > 0) == sloppy)
        return c if cut is None else c.where((F.col("cutoff") > 0) == cut)

    for cut in (False, True):
        if (WORD, False, cut) in kinds or (WORD, True, cut) in kinds:
            q = of(WORD, cut=cut).select("qid", "cid", F.col("terms")[0].alias("term"), "cutoff")
            p = postings.join(small(q), "term")
            if cut:
                p = p.where(F.col("offsets")[0] < F.col("cutoff"))
            out.append(p.select("qid", "cid", "docno", "f_dt"))
    if any(k[0] == AND for k in kinds):
        q = of(AND).select("qid", "cid", "cutoff", F.size("terms").alias("k"), F.explode("terms").alias("term"))
        cut = any(k[0] == AND and k[2] for k in kinds)
        first = F.col("offsets")[0] if cut else F.lit(0)
        p = postings.join(small(q), "term").select("qid", "cid", "docno", "f_dt", "k", "cutoff", first.alias("first"))
        p = p.groupBy("qid", "cid", "docno").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.min("f_dt").alias("f_dt"), F.max("first").alias("first"), F.first("cutoff").alias("cutoff"))
        p = p.where("n = k and (cutoff = 0 or first < cutoff)")
        out.append(p.select("qid", "cid", "docno", "f_dt"))
    if any(k[0] == PHRASE for k in kinds):
        q = of(PHRASE).select("qid", "cid", "slop", "cutoff", F.size("terms").alias("k"), F.posexplode("terms").alias("i", "term"))
        ends = F.transform("offsets", lambda o: o + F.col("k") - 1 - F.col("i"))
        p = postings.join(small(q), "term").select("qid", "cid", "docno", "slop", "cutoff", "k", "i", ends.alias("ends"))
        if any(k[0] == PHRASE and not k[1] for k in kinds):
            # one row for each document, not one for each place: what all words' shifted places have in common
            e = p.where("slop = 0").groupBy("qid", "cid", "docno").agg(F.collect_list("ends").alias("parts"), F.first("k").alias("k"), F.first("cutoff").alias("cutoff")).where(F.size("parts") == F.col("k"))
            common = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0], lambda x, y: F.array_intersect(x, y))
            e = e.withColumn("common", common).select("qid", "cid", "docno", F.size("common").alias("f_dt"), F.array_min("common").alias("first"), "cutoff").where("f_dt > 0")
            out.append(e.where("cutoff = 0 or first < cutoff").select("qid", "cid", "docno", "f_dt"))
        if any(k[0] == PHRASE and k[1] for k in kinds):
            s = p.where("slop > 0").groupBy("qid", "cid", "docno").agg(F.first("slop").alias("slop"), F.array_sort(F.collect_list(F.struct("i", "ends"))).alias("parts"), F.first("k").alias("k"), F.first("cutoff").alias("cutoff"))
            s = s.where(F.size("parts") == F.col("k"))
            hits = _sloppy(s.select("qid", "cid", "docno", "slop", "parts"))
            cuts = of(PHRASE, True).select("qid", "cid", "cutoff")
            hits = hits.join(small(cuts), ["qid", "cid"]).where("cutoff = 0 or first < cutoff")
            out.append(hits.select("qid", "cid", "docno", "f_dt"))
    if not out:
        return postings.sparkSession.createDataFrame([], "qid string, cid int, docno long, f_dt int")
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole
