"""Reranking: a scorer reorders the best documents of each query, and the rest follows below them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.sources.index import Index

#: Up to so many best documents are a filter; more are joined.
FILTER_DOCS = 1000
#: Takes (qid, docid, ext_id, score, rank) of the best documents, gives (qid, docid, ext_id, score).
Scorer = Callable[[DataFrame], DataFrame]


def rerank(ranking: DataFrame, scorer: Scorer, depth: int = 1000) -> DataFrame:
    """Documents beyond the depth keep their order. Where the first of them would stand above what the scorer gives,
    all of them are shifted down to end 0.1 below the lowest reranked one. A scorer may return fewer documents."""
    best = scorer(ranking.where(F.col("rank") <= depth)).select("qid", "docid", "ext_id", F.col("score").alias("score"))
    tail = ranking.where(F.col("rank") > depth)
    lowest = best.groupBy("qid").agg(F.min("score").alias("low"))
    # The tail's first score is that of the first document beyond the depth.
    heads = tail.groupBy("qid").agg(F.min_by("score", "rank").alias("head")).join(lowest, "qid", "left")
    shift = heads.select("qid", F.greatest(F.lit(0.0), F.col("head") + 0.1 - F.coalesce("low", "head")).alias("shift"))
    moved = tail.join(shift, "qid").select("qid", "docid", "ext_id", (F.col("score") - F.col("shift")).alias("score"), (F.col("rank") + F.lit(0)).alias("old"))
    both = best.withColumn("part", F.lit(0)).withColumn("old", F.lit(0)).unionByName(moved.withColumn("part", F.lit(1)))
    order = Window.partitionBy("qid").orderBy("part", F.when(F.col("part") == 0, -F.col("score")), "old", "docid")
    return both.withColumn("rank", F.row_number().over(order)).select("qid", "docid", "ext_id", "score", "rank")


def linear_scorer(index: Index, weights: dict[str, float]) -> Scorer:
    """score = weights of `score`, `rank`, and `length:<field>` (with stopwords), summed."""

    def scorer(best: DataFrame) -> DataFrame:
        lengths = [name for name in weights if name.startswith("length:")]
        # Few documents are a filter that reaches the files: no other text is split into words.
        docids = [r.docid for r in best.select("docid").distinct().limit(FILTER_DOCS + 1).collect()] if lengths else []
        few = F.col("docid").isin(docids) if len(docids) <= FILTER_DOCS else F.lit(True)
        for name in weights:
            if name in lengths:
                own = index.doc_len.where(few & (F.col("field") == name[7:])).select("docid", F.col("len_all").alias(name))
                best = best.join(own, "docid", "left").fillna(0, [name])
        total = sum((F.col(f"`{n}`") * w for n, w in weights.items()), F.lit(0.0))
        return best.select("qid", "docid", "ext_id", total.cast("double").alias("score"))

    return scorer
