"""Similarity metrics: what a posting adds to a document's score, and what is done to the sum."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .index import Params

FLT_EPSILON = 1.1920929e-07


class Metric(Protocol):
    """A metric of one's own needs these: Columns df, cf, f_dt, f_qt, and words, weight of the document.

    contrib_of and post_of are the same formulas for arrays; with them, many queries are scored at once.
    """

    needs_docs: bool  # whether contrib or post use words or weight

    def contrib(self, p: Params) -> Column: ...

    def post(self, score: Column, p: Params) -> Column: ...


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _ln1(name: str) -> Column:
    return 1 + F.log(_c(name))


def _idf(p: Params) -> Column:
    return F.log((F.lit(float(p.N)) - _c("df") + 0.5) / (_c("df") + 0.5))


@dataclass(frozen=True)
class Dirichlet:
    """Language model with Dirichlet smoothing, the default."""

    mu: float = 1500.0
    needs_docs = True

    def contrib(self, p: Params) -> Column:
        return F.log(1 + _c("f_dt") * float(p.terms) / (self.mu * _c("cf")))

    def post(self, score: Column, p: Params) -> Column:
        return score + F.col("q_terms") * F.log(self.mu / (self.mu + _c("words")))

    def contrib_of(self, p, f_dt, f_qt, df, cf, words):
        return np.log(1 + f_dt * float(p.terms) / (self.mu * cf))

    def post_of(self, score, p, q_terms, q_weight, words, weight):
        return score + q_terms * np.log(self.mu / (self.mu + words))


@dataclass(frozen=True)
class Okapi:
    """BM25; a term in more than half of the documents has the least positive weight."""

    k1: float = 1.2
    k3: float = 1e10
    b: float = 0.75
    needs_docs = True

    def contrib(self, p: Params) -> Column:
        idf = _idf(p)
        w = F.when(idf <= 0, FLT_EPSILON).otherwise(idf)
        r = (self.k3 + 1) * _c("f_qt") / (self.k3 + _c("f_qt"))
        length = self.k1 * ((1 - self.b) + self.b * _c("words") / (p.avg_words or 1.0))
        return r * w * (self.k1 + 1) * _c("f_dt") / (length + _c("f_dt"))

    def post(self, score: Column, p: Params) -> Column:
        return score

    def contrib_of(self, p, f_dt, f_qt, df, cf, words):
        idf = np.log((float(p.N) - df + 0.5) / (df + 0.5))
        r = (self.k3 + 1) * f_qt / (self.k3 + f_qt)
        length = self.k1 * ((1 - self.b) + self.b * words / (p.avg_words or 1.0))
        return r * (FLT_EPSILON if idf <= 0 else idf) * (self.k1 + 1) * f_dt / (length + f_dt)

    def post_of(self, score, p, q_terms, q_weight, words, weight):
        return score


@dataclass(frozen=True)
class Cosine:
    needs_docs = True

    def contrib(self, p: Params) -> Column:
        return _ln1("f_qt") * _ln1("f_dt")

    def post(self, score: Column, p: Params) -> Column:
        return score / (_c("weight") * F.col("q_weight"))

    def contrib_of(self, p, f_dt, f_qt, df, cf, words):
        return (1 + np.log(f_qt)) * (1 + np.log(f_dt))

    def post_of(self, score, p, q_terms, q_weight, words, weight):
        return score / (weight * q_weight)


@dataclass(frozen=True)
class PivotedCosine:
    pivot: float = 0.2
    needs_docs = True

    def contrib(self, p: Params) -> Column:
        return _c("f_qt") * F.log(1 + float(p.N) / _c("df")) * _ln1("f_dt")

    def post(self, score: Column, p: Params) -> Column:
        return score / ((1 - self.pivot) + self.pivot * _c("weight") / (p.avg_weight or 1.0))

    def contrib_of(self, p, f_dt, f_qt, df, cf, words):
        return f_qt * np.log(1 + float(p.N) / df) * (1 + np.log(f_dt))

    def post_of(self, score, p, q_terms, q_weight, words, weight):
        return score / ((1 - self.pivot) + self.pivot * weight / (p.avg_weight or 1.0))


@dataclass(frozen=True)
class AF1:
    """An Okapi variant without document length; weights may be negative."""

    alpha: float = 1.0
    k3: float = 1e10
    needs_docs = False

    def contrib(self, p: Params) -> Column:
        r = (self.k3 + 1) * _c("f_qt") / (self.k3 + _c("f_qt"))
        return r * self.alpha * F.log(_c("f_dt") + 1) * _idf(p)

    def post(self, score: Column, p: Params) -> Column:
        return score

    def contrib_of(self, p, f_dt, f_qt, df, cf, words):
        r = (self.k3 + 1) * f_qt / (self.k3 + f_qt)
        return r * self.alpha * np.log(f_dt + 1) * np.log((float(p.N) - df + 0.5) / (df + 0.5))

    def post_of(self, score, p, q_terms, q_weight, words, weight):
        return score


@dataclass(frozen=True)
class Impact:
    """Impact-ordered evaluation; the index must have impacts, queries must be words only."""


METRICS = {"dirichlet": Dirichlet, "okapi": Okapi, "okapi_k3": Okapi, "cosine": Cosine, "pcosine": PivotedCosine, "hawkapi": AF1, "af1": AF1, "impact": Impact}
