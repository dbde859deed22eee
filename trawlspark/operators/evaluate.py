"""Evaluation of runs against judgements, and the Wilcoxon signed-rank test between runs."""

from __future__ import annotations

from functools import cache
from math import erf, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
LEVELS = tuple(range(11))
MEASURES = ("ap", *(f"p{k}" for k in CUTOFFS), "r_prec")


def order_run(run: DataFrame) -> DataFrame:
    """run with rank: by score, then by document id, both falling."""
    own = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docno"))
    return run.withColumn("rank", F.row_number().over(own))


def evaluate_queries(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query of the run: retrieved, relevant, rel_ret, ap, p at cutoffs, r_prec and interpolated precision i0 to i10.

    One join with the judgements and windows over each query's ranks.
    """
    rel = qrels.groupBy("qid", "docno").agg((F.max("rel") != 0).cast("int").alias("rel"))
    relevant = rel.where("rel = 1").groupBy("qid").agg(F.count("*").alias("relevant"))
    r = order_run(run.select("qid", "docno", "score")).join(rel, ["qid", "docno"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("qid").orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    r = r.withColumn("hits", F.sum("rel").over(upto)).withColumn("prec", F.col("hits") / F.col("rank"))
    r = r.withColumn("best", F.max(F.when(F.col("rel") == 1, F.col("prec")).otherwise(0.0)).over(later))
    r = r.join(relevant, "qid", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    at = [(F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / float(k)).alias(f"p{k}") for k in CUTOFFS]
    levels = [
        F.coalesce(F.max(F.when((F.col("rel") == 1) & (F.col("hits") >= F.greatest(F.lit(1), F.ceil(F.col("relevant") * i / 10))), F.col("best"))), F.lit(0.0)).alias(f"i{i}")
        for i in LEVELS
    ]
    rel_n = F.first("relevant")
    ap = F.sum(F.when(F.col("rel") == 1, F.col("prec")).otherwise(0.0))
    r_prec = F.sum(F.when(F.col("rank") <= F.col("relevant"), F.col("rel")).otherwise(0))
    safe = lambda x: F.when(rel_n > 0, x / rel_n).otherwise(0.0)
    return r.groupBy("qid").agg(F.count("*").alias("retrieved"), rel_n.alias("relevant"), F.sum("rel").alias("rel_ret"), safe(ap).alias("ap"), *at, safe(r_prec).alias("r_prec"), *levels)


def evaluate(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Means over the run's queries, sums of the counts: one row."""
    q = evaluate_queries(run, qrels)
    counts = [F.sum(c).alias(c) for c in ("retrieved", "relevant", "rel_ret")]
    means = [F.avg(c).alias(c) for c in (*MEASURES, *(f"i{i}" for i in LEVELS))]
    return q.agg(F.count("*").alias("queries"), *counts, *means)


def extras(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query: recall at cutoffs, fallout, relative precision at cutoffs and the three-point average."""
    q = evaluate_queries(run, qrels)
    rel = F.greatest(F.col("relevant"), F.lit(1))
    recall = [(F.col(f"p{k}") * k / rel).alias(f"recall{k}") for k in CUTOFFS]
    relative = [(F.col(f"p{k}") * k / F.greatest(F.lit(1), F.least(F.lit(k), F.col("relevant")))).alias(f"rel_p{k}") for k in CUTOFFS]
    return q.select("qid", *recall, *relative, (F.col("retrieved") - F.col("rel_ret")).alias("nonrel_ret"), ((F.col("i2") + F.col("i5") + F.col("i8")) / 3).alias("three_point"))


def report(evaluation: DataFrame) -> str:
    """The usual text report of evaluate()'s row."""
    e = evaluation.first()
    lines = [f"Queryid (Num): {e.queries:8d}", "Total number of documents over all queries", f"    Retrieved: {e.retrieved:8d}", f"    Relevant:  {e.relevant:8d}", f"    Rel_ret:   {e.rel_ret:8d}", "Interpolated Recall - Precision Averages:"]
    lines += [f"    at {i / 10:.2f}       {e[f'i{i}']:.4f}" for i in LEVELS]
    lines += ["Average precision (non-interpolated) for all rel docs", f"                  {e.ap:.4f}", "Precision:"]
    lines += [f"  At {k:4d} docs:   {e[f'p{k}']:.4f}" for k in CUTOFFS]
    lines += ["R-Precision (precision after R docs retrieved):", f"    Exact:        {e.r_prec:.4f}"]
    return "\n".join(lines)


@cache
def critical(n: int, alpha: float) -> int:
    """The greatest T with a two-tailed probability of at most alpha; -1 where there is none. From the exact distribution."""
    ways = [1]
    for r in range(1, n + 1):
        more = ways + [0] * r
        for i, w in enumerate(ways):
            more[i + r] += w
        ways = more
    total, seen, best = 2**n, 0, -1
    for t, w in enumerate(ways):
        seen += w
        if 2 * seen > alpha * total:
            break
        best = t
    return best


def wilcoxon(a: DataFrame, b: DataFrame, qrels: DataFrame, tails: int = 2) -> DataFrame:
    """(measure, n, improved, degraded, w_plus, w_minus, z, hypothesis, alpha, p_value) of run b against run a.

    improved counts queries where b is better. Missing queries count as zero. Ranks of absolute
    differences, ties at their mean; up to 50 differing queries the exact critical value decides.
    """
    cols = [f"stack({len(MEASURES)}, " + ", ".join(f"'{m}', x.{m}, y.{m}" for m in MEASURES) + ") as (measure, va, vb)"]
    x, y = evaluate_queries(a, qrels).alias("x"), evaluate_queries(b, qrels).alias("y")
    d = x.join(y, F.col("x.qid") == F.col("y.qid"), "full_outer").selectExpr(*cols)
    d = d.select("measure", F.round(F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0)), 12).alias("d"))
    own = Window.partitionBy("measure").orderBy(F.abs("d"))
    ties = Window.partitionBy("measure", F.abs("d"))
    ranks = d.where("d <> 0").withColumn("r", F.rank().over(own)).withColumn("r", F.col("r") + (F.count("*").over(ties) - 1) / 2)
    s = ranks.groupBy("measure").agg(F.count("*").alias("n"), F.sum((F.col("d") < 0).cast("int")).alias("improved"), F.sum((F.col("d") > 0).cast("int")).alias("degraded"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"))
    have = {r.measure: r for r in s.collect()}  # eleven rows
    out = []
    for m in MEASURES:
        r = have.get(m)
        if r is None:
            out.append((m, 0, 0, 0, 0.0, 0.0, 0.0, "no difference", 0.0, 1.0))
            continue
        n = r.n
        z = round((r.w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 2)
        p = (1 - erf(abs(z) / sqrt(2))) * (1 if tails == 2 else 0.5)
        t, hypothesis, alpha = int(min(r.w_plus, r.w_minus)), "out of range", 0.0
        if n <= 50 and critical(n, 0.1) >= 0:
            if t <= critical(n, 0.05):
                hypothesis, alpha = "rejected", 0.05
            elif tails == 2 and t <= critical(n, 0.1):
                hypothesis, alpha = "rejected", 0.1
            else:
                hypothesis, alpha = "not rejected", 0.05 if tails == 1 else 0.1
        out.append((m, n, r.improved, r.degraded, r.w_plus, r.w_minus, z, hypothesis, alpha, p))
    return a.sparkSession.createDataFrame(out, "measure string, n long, improved long, degraded long, w_plus double, w_minus double, z double, hypothesis string, alpha double, p_value double")
