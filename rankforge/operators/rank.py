"""Ranking: queries in, the best documents of each out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.plans.compile import scores
from rankforge.plans.parser import parse
from rankforge.plans.rewrite import optimize, prepare
from rankforge.sources.index import Index


def top(scored: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, docid, ext_id, score, rank) of scored(qid, docid, score): score down, docid up, an external id once.

    External ids are unique in an index, so the cut comes first and only what is left is joined with docs; the
    ranks' window is limited map-side.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(docs.select("docid", "ext_id"), "docid")
    return named.select("qid", "docid", "ext_id", "score", "rank")


def top_distinct(scored: DataFrame, k: int) -> DataFrame:
    """The same over scored(qid, docid, ext_id, score) where external ids repeat: the best of each stays."""
    order = [F.desc("score"), F.asc("docid")]
    first = scored.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "ext_id").orderBy(*order))).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k).select("qid", "docid", "ext_id", "score", "rank")


def trees_of(index: Index, queries: dict[str, str], model) -> dict:
    """Trees of the queries of which anything is left."""
    trees = {qid: prepare(optimize(parse(q, index.analyzer, model.default))) for qid, q in queries.items()}
    return {qid: t for qid, t in trees.items() if t is not None}


def rank(index: Index, queries: dict[str, str], model, k: int = 1000, digits: int | None = None, repeated_ids: bool = False) -> DataFrame:
    """Rankings of a batch of queries. A query of stopwords alone has none. digits: scores are rounded before ranking.

    repeated_ids: several documents may have one external id, of which the best one counts; names then come before the cut.
    """
    scored = scores(index, trees_of(index, queries, model), model)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    if repeated_ids:
        return top_distinct(scored.join(index.docs.select("docid", "ext_id"), "docid"), k)
    return top(scored, index.docs, k)
