"""Effectiveness of runs: the customary measures over a run and judgements.

Documents are ordered by score down, then external id down; relevant is a judgement above 0. Averages are over the queries that
both the run and the judgements have, in a row with qid `all`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels under which the second set of measures is reported.
LABELS = {
    "recip_rank": "MRR", "P_10": "P@10", "P_20": "P@20", "P_30": "P@30", "map_cut_1000": "MAP@1K", "ndcg_cut_10": "NDCG@10", "ndcg_cut_20": "NDCG@20",
    "ndcg_cut_30": "NDCG@30", "recall_100": "R@100", "recall_1000": "R@1000",
}
CUTS, NDCG_CUTS, RECALL_CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000), (5, 10, 15, 20, 30, 100, 200, 500, 1000), (100, 500, 1000)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, ext_id, place, rel) of run(qid, ext_id, score), for queries with judgements."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("ext_id")))
    known = qrels.select("qid").distinct()
    placed = run.select("qid", "ext_id", "score").join(known, "qid", "left_semi").withColumn("place", place)
    return placed.join(qrels.select("qid", "ext_id", "rel"), ["qid", "ext_id"], "left").select("qid", "ext_id", "place", F.coalesce("rel", F.lit(0)).alias("rel"))


def per_query(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """A row for each query: all measures as columns."""
    rows = judged(run, qrels)
    hit = (F.col("rel") > 0).cast("int")
    rows = rows.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(Window.partitionBy("qid").orderBy("place")))
    gain = F.greatest(F.col("rel"), F.lit(0)) / F.log2(F.col("place") + 1.0)
    ideal_place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "ext_id"))
    ideal = qrels.where("rel > 0").withColumn("place", ideal_place).withColumn("g", F.col("rel") / F.log2(F.col("place") + 1.0))
    within = lambda k, x: F.sum(F.when(F.col("place") <= k, x).otherwise(0))
    ideals = ideal.groupBy("qid").agg(F.count("*").alias("num_rel"), F.sum("g").alias("ideal"), *(within(k, F.col("g")).alias(f"ideal_{k}") for k in NDCG_CUTS))
    precise = F.col("hit") * F.col("hits") / F.col("place")
    sums = rows.groupBy("qid").agg(
        F.count("*").alias("num_ret"),
        F.sum("hit").alias("num_rel_ret"),
        F.sum(precise).alias("precision"),
        within(1000, precise).alias("precision_1000"),
        F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"),
        F.sum(gain).alias("gain"),
        *(within(k, gain).alias(f"gain_{k}") for k in NDCG_CUTS),
        *(within(k, F.col("hit")).alias(f"hits_{k}") for k in CUTS),
    )
    all_ = sums.join(ideals, "qid", "left").fillna(0, ["num_rel"])
    share = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(0.0)
    rel: Column = F.col("num_rel")
    return all_.select(
        "qid", "num_ret", "num_rel", "num_rel_ret",
        share(F.col("precision"), rel).alias("map"), share(F.col("precision_1000"), rel).alias("map_cut_1000"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("recip_rank"), share(F.col("gain"), F.col("ideal")).alias("ndcg"),
        *((F.col(f"hits_{k}") / F.lit(float(k))).alias(f"P_{k}") for k in CUTS),
        *(share(F.col(f"gain_{k}"), F.col(f"ideal_{k}")).alias(f"ndcg_cut_{k}") for k in NDCG_CUTS),
        *(share(F.col(f"hits_{k}"), rel).alias(f"recall_{k}") for k in RECALL_CUTS),
    )


def measures(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(metric, qid, value): every measure of every query, and of `all` (sums of counts, means of the rest).

    One pass over the ranking: both kinds of rows are grouping sets of one table of queries x measures.
    """
    wide = per_query(run, qrels).withColumn("num_q", F.lit(1.0))
    sums = ["num_ret", "num_rel", "num_rel_ret", "num_q"]
    names = [c for c in wide.columns if c != "qid"]
    long = wide.select("qid", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("m.metric", "qid", "m.value")
    both = long.groupingSets([["metric", "qid"], ["metric"]], "metric", "qid").agg(F.sum("value").alias("s"), F.avg("value").alias("a"), F.grouping("qid").alias("overall"))
    both = both.where((F.col("overall") == 1) | (F.col("metric") != "num_q"))
    value = F.when(F.col("metric").isin(sums), F.col("s")).otherwise(F.col("a"))
    return both.select("metric", F.when(F.col("overall") == 1, "all").otherwise(F.col("qid")).alias("qid"), value.alias("value"))


def labelled(found: DataFrame) -> DataFrame:
    """(label, value) of the second set; a measure that is absent is NA."""
    names = F.broadcast(found.sparkSession.createDataFrame(list(LABELS.items()), "metric string, label string"))
    overall = found.where("qid = 'all'").select("metric", F.format_string("%.4f", "value").alias("value"))
    return names.join(overall, "metric", "left").select("label", F.coalesce("value", F.lit("NA")).alias("value"))


def map_per_query(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return per_query(run, qrels).select("qid", "map")


def win_tie_loss(baseline: DataFrame, other: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(qid, base, exp, outcome) of two frames (qid, map): by each query of the baseline, a missing one counts 0."""
    rows = baseline.select("qid", F.col("map").alias("base")).join(other.select("qid", F.col("map").alias("exp")), "qid", "left").fillna(0.0, ["exp"])
    change = F.when(F.col("base") != 0, (F.col("exp") - F.col("base")) / F.col("base")).when(F.col("exp") > 0, F.lit(float("inf"))).otherwise(0.0)
    outcome = F.when(change >= threshold, "WIN").when(change <= -threshold, "LOSS").otherwise("TIE")
    return rows.select("qid", "base", "exp", outcome.alias("outcome"))


def pivot(found: DataFrame, runs: list[str]) -> DataFrame:
    """metrics(run, metric, qid, value) with a column for each run."""
    return found.groupBy("metric", "qid").pivot("run", runs).agg(F.first("value"))


def missing_lines(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(metric, qid, value) lines of `all` that are expected and not there; a match has none, and may have more."""
    lines = lambda df: df.where("qid = 'all'").select("metric", "qid", "value")
    return lines(expected).exceptAll(lines(got))
