"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features of a text are its lower-case words, their first three, four and five letters, and for each
of these whether it occurs at least 2, 3, 4, 6 or 8 times. The vocabulary holds those features whose
frequency among toxic examples is significantly high (log-likelihood ratio G). The index holds the
examples' unit vectors in blocks with each feature's largest weight; a search takes blocks by falling
bound and stops when no further block can reach the k-th best, so its neighbours are exact. Their
votes, weighted by cosine and shrunk to the labels' prior, are the score; their ids are the evidence.
"""

from __future__ import annotations

from collections import Counter
from math import fsum, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, filtered, map_lists, written

#: At most so many labelled documents are examples: those whose ids' hashes are the least.
MAX_EXAMPLES = 20_000
MAX_FEATURES = 4096
#: Least G of a feature: MIN_G, or with few examples as much less as their number, but no less than LEAST_G.
MIN_G, G_A_ROW, LEAST_G = 30.0, 0.02, 11.0
MIN_EXAMPLES = 3
NEIGHBOURS = 16
#: Weight of the prior among the votes.
PRIOR_WEIGHT = 0.5
BLOCK = 128
_LEVELS = (2, 3, 4, 6, 8)
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>-"
_KEPT = 200_000


def _bases(word: str) -> list[str]:
    w = word.strip(_STRIP)
    if not w:
        return []
    return [w, *(w[:n] + "~" for n in (3, 4, 5) if len(w) > n)]


def features(text: str | None) -> dict[str, int]:
    """All features of a text with their counts (1 for a level)."""
    counts: Counter = Counter()
    for w, n in Counter((text or "").lower().split()).items():
        for b in _bases(w):
            counts[b] += n
    out = dict(counts)
    for b, n in counts.items():
        for level in _LEVELS:
            if n < level:
                break
            out[f"{b}@{level}"] = 1
    return out


class Vectors:
    """Unit TF-IDF vectors over a vocabulary: features with their inverse document frequencies."""

    def __init__(self, idf: dict[str, float]):
        self.names = sorted(idf)
        self.idf = np.array([idf[n] for n in self.names])
        self.bases: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.names):
            base, _, level = n.rpartition("@")
            self.bases.setdefault(base or n, []).append((i, int(level) if base else 0))
        self.memo: dict[str, tuple] = {}

    def counts(self, text: str | None) -> tuple:
        """((feature, count), ...) of a text, the features in order."""
        memo, found = self.memo, {}
        for w, n in Counter((text or "").lower().split()).items():
            hits = memo.get(w)
            if hits is None:
                if len(memo) >= _KEPT:
                    memo.clear()
                hits = memo[w] = tuple(b for b in _bases(w) if b in self.bases)
            for b in hits:
                found[b] = found.get(b, 0) + n
        out = []
        for b, n in found.items():
            out += [(i, 1 if level else n) for i, level in self.bases[b] if n >= level]
        return tuple(sorted(out))

    def unit(self, counts: tuple) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([i for i, _ in counts], np.int64)
        w = (1 + np.log([n for _, n in counts])) * self.idf[at]
        return at, w / np.sqrt(w @ w)


class BlockMaxIndex:
    """The examples' vectors as postings in blocks of BLOCK examples, with block maxima."""

    def __init__(self, vectors: Vectors, examples: list[tuple[object, int, tuple]], prior: float, blank: float | None = None):
        self.vectors, self.prior, self.blank = vectors, prior, prior if blank is None else blank
        held = [(i, y, c) for i, y, c in examples if c]
        held.sort(key=lambda e: (e[2], str(e[0])))  # alike examples share blocks
        self.ids = [e[0] for e in held]
        self.label = np.array([e[1] for e in held], float)
        n = len(held)
        self.blocks = -(-n // BLOCK)
        terms: list[list[tuple[int, float]]] = [[] for _ in vectors.names]
        for e, (_, _, c) in enumerate(held):
            for t, w in zip(*(x.tolist() for x in vectors.unit(c))):
                terms[t].append((e, w))
        self.at = [np.array([e for e, _ in t], np.int64) for t in terms]
        self.w = [np.array([w for _, w in t]) for t in terms]
        self.cut = np.array([np.searchsorted(a, np.arange(self.blocks + 1) * BLOCK) for a in self.at], np.int64).reshape(len(terms), self.blocks + 1)
        self.top = np.zeros((len(terms), self.blocks))
        for t, (a, w) in enumerate(zip(self.at, self.w)):
            np.maximum.at(self.top[t], a // BLOCK, w)
        self.memo: dict[tuple, tuple] = {}

    def near(self, counts: tuple, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a shared feature and of all as near as the k-th: by cosine, then by place."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not counts or not self.ids:
            return none
        at, q = self.vectors.unit(counts)
        bound = q @ self.top[at]
        best, cosines = none
        for b in np.argsort(-bound, kind="stable").tolist():
            least = cosines[k - 1] if len(cosines) >= k else 0.0
            if bound[b] <= 0 or bound[b] < least - 1e-9:
                break
            acc = np.zeros(BLOCK)
            for t, x in zip(at.tolist(), q.tolist()):
                s, e = self.cut[t, b], self.cut[t, b + 1]
                if e > s:
                    acc[self.at[t][s:e] - b * BLOCK] += x * self.w[t][s:e]
            acc = np.round(acc, 12)
            hit = np.flatnonzero((acc > 0) & (acc >= least))
            best, cosines = np.concatenate([best, hit + b * BLOCK]), np.concatenate([cosines, acc[hit]])
            order = np.lexsort((best, -cosines))
            best, cosines = best[order], cosines[order]
            if len(best) > k:
                end = np.searchsorted(-cosines, -cosines[k - 1], side="right")
                best, cosines = best[:end], cosines[:end]
        return best, cosines

    def nearest(self, counts: tuple, k: int = NEIGHBOURS) -> list[tuple[int, float]]:
        """(example, cosine) of the k nearest with a shared feature: by cosine, then by place."""
        return list(zip(*(x[:k].tolist() for x in self.near(counts, k))))

    def votes(self, best: np.ndarray, cosines: np.ndarray, k: int = NEIGHBOURS) -> tuple[float, float]:
        """(cosines of toxic neighbours, of all) of k; examples that tie for the last places share them, so that their order doesn't matter."""
        share = np.ones(len(best))
        if len(best) > k:
            tied = cosines == cosines[-1]
            share[tied] = (k - np.sum(~tied)) / np.sum(tied)
        return fsum(share * cosines * self.label[best]), fsum(share * cosines)

    def score(self, counts: tuple) -> tuple[float, list]:
        """(score, ids of the three nearest examples) of a text's counts."""
        known = self.memo.get(counts)
        if known is None:
            best, cosines = self.near(counts)
            toxic, weight = self.votes(best, cosines)
            prior = self.prior if weight else self.blank
            known = ((toxic + prior * PRIOR_WEIGHT) / (weight + PRIOR_WEIGHT), [self.ids[e] for e in best[:3].tolist()])
            if len(self.memo) >= _KEPT:
                self.memo.clear()
            self.memo[counts] = known
        return known


def _g(n: int, toxic: int, all_n: int, all_toxic: int) -> float:
    """Log-likelihood ratio of a feature's presence against the label."""
    x = lambda v: v * log(v) if v > 0 else 0.0
    a, b, c = toxic, n - toxic, all_toxic - toxic
    d = all_n - a - b - c
    return 2 * (x(a) + x(b) + x(c) + x(d) - x(n) - x(c + d) - x(all_toxic) - x(b + d) + x(all_n))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], list, float, float]:
    """(idf by feature, examples, prior, the share of toxic ones among examples without a feature) from at most MAX_EXAMPLES labelled rows of docs.

    Held-out rows (fold 0 of doc_fold) teach nothing. Repeated labels of an id count as its largest,
    repeated rows as one; null ids, labels and texts teach nothing. The driver gets the vocabulary, at
    most MAX_FEATURES, and the examples' counts over it.
    """
    spark = docs.sparkSession
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(doc_fold(F.col("id")) != 0).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(MAX_EXAMPLES)
    sample = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    sample = written(sample.dropDuplicates(["id"]), "toxic-examples")

    def count(batches):
        for b in batches:
            n, toxic = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = features(t)
                n.update(f.keys())
                if y:
                    toxic.update(f.keys())
            keep = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string()), pa.array([n[f] for f in keep], pa.int64()), pa.array([toxic[f] for f in keep], pa.int64())], names=["f", "n", "toxic"])

    all_n, all_toxic = sample.agg(F.count("*"), F.sum("y")).first()
    if not all_n or not all_toxic:
        return {}, [], 0.0, 0.0
    rows = sample.select("text", "y").mapInArrow(count, "f string, n long, toxic long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    rows = rows.where((F.col("n") >= MIN_EXAMPLES) & (F.col("toxic") * all_n > F.col("n") * all_toxic))
    x = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    a, b = F.col("toxic").cast("double"), (F.col("n") - F.col("toxic")).cast("double")
    c = all_toxic - a
    d = all_n - a - b - c
    g = 2 * (x(a) + x(b) + x(c) + x(d) - x(a + b) - x(c + d) - x(F.lit(float(all_toxic))) - x(b + d) + x(F.lit(float(all_n))))
    rows = rows.withColumn("g", g).where(F.col("g") >= min(MIN_G, max(LEAST_G, G_A_ROW * all_n))).orderBy(F.desc(F.round("g", 6)), "f").limit(MAX_FEATURES)
    idf = {r.f: log((1 + all_n) / (1 + r.n)) + 1 for r in rows.collect()}
    vocabulary = spark.sparkContext.broadcast(idf)

    def make():
        v = Vectors(vocabulary.value)
        return lambda ids, texts, ys: (ids, ys, [[x for p in v.counts(t) for x in p] for t in texts])

    kind = dict(docs.dtypes)[id_col]
    found = map_lists(sample.select("id", "text", "y"), make, f"id {kind}, y int, c array<int>").where(F.size("c") > 0).collect()
    examples = [(r.id, r.y, tuple(zip(r.c[::2], r.c[1::2]))) for r in found]
    prior = all_toxic / all_n
    blank = (all_toxic - sum(y for _, y, _ in examples) + prior) / (all_n - len(examples) + 1)
    return idf, examples, prior, blank


def _shared(docs: DataFrame, model) -> object:
    return docs.sparkSession.sparkContext.broadcast(model)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted, evidence) of each row; evidence: ids of the nearest examples.

    Every row comes back, equal rows with equal scores. A null text is empty; a text without a
    feature of the vocabulary has the share of toxic ones among such examples as its score and no evidence. Without toxic
    labels to learn from every score is 0. Other columns aren't read. Examples as near as the last neighbour
    share its place, so no score depends on ids. An empty table gives no rows; texts are read whole.
    """
    model = _shared(docs, fit(docs, labels, id_col, text_col, label_col))
    kind = dict(docs.dtypes)[id_col]

    def make():
        idf, *rest = model.value
        index = BlockMaxIndex(Vectors(idf), *rest)

        def f(ids, held, texts):
            out = [index.score(index.vectors.counts(t)) for t in texts]
            return ids, held, [s for s, _ in out], [int(s >= 0.5) for s, _ in out], [e for _, e in out]

        return f

    rows = docs.select(docs[id_col], (doc_fold(docs[id_col]) == 0).alias("held_out"), docs[text_col])
    return map_lists(rows, make, f"{id_col} {kind}, held_out boolean, score double, predicted int, evidence array<{kind}>")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, all columns, that scored() doesn't predict to be toxic.

    Equal texts go or stay together; null and empty texts, repeated rows and empty tables are as in scored().
    """
    model = _shared(docs, fit(docs, labels, id_col, text_col, label_col))
    place = docs.columns.index(text_col)

    def run(batches):
        idf, *rest = model.value
        index = BlockMaxIndex(Vectors(idf), *rest)
        for b in batches:
            keep = [index.score(index.vectors.counts(t))[0] < 0.5 for t in b.column(place).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return filtered(docs, run)
