"""Retrieval models: what a document scores for the postings below a SCORE operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UnrankedBoolean:
    default = "#AND"
    uses_statistics = False

    def score(self, tf: Column, df: Column, length: Column, average: Column, num_docs: int) -> Column:
        return F.lit(1.0)


@dataclass(frozen=True)
class RankedBoolean:
    default = "#AND"
    uses_statistics = False

    def score(self, tf: Column, df: Column, length: Column, average: Column, num_docs: int) -> Column:
        return tf.cast("double")


@dataclass(frozen=True)
class BM25:
    """Weights of operators other than terms use the operator's own df."""

    k1: float = 1.2
    b: float = 0.75
    default = "#SUM"
    uses_statistics = True

    def score(self, tf: Column, df: Column, length: Column, average: Column, num_docs: int) -> Column:
        idf = F.log((F.lit(float(num_docs)) - df + 0.5) / (df + 0.5) + 1.0)
        return idf * (tf * (self.k1 + 1)) / (tf + self.k1 * (1 - self.b + self.b * length / average))


def from_parameters(p: dict):
    kind = p.get("type")
    if kind == "UnrankedBoolean":
        return UnrankedBoolean()
    if kind == "RankedBoolean":
        return RankedBoolean()
    if kind == "BM25":
        return BM25(float(p.get("BM25:k_1", p.get("k1", 1.2))), float(p.get("BM25:b", p.get("b", 0.75))))
    raise ValueError(f"unknown retrieval model {kind!r}")
