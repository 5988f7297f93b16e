"""Pseudo-relevance feedback: terms of the best documents expand the query.

Term scores are one plan for all queries: the best documents (queries x num_docs rows, which the driver holds) meet their
postings, scores are summed by query and term, and the best terms are cut by rank. Over a written index the documents are
a filter that reaches the files sorted by document, and document frequencies are read, not counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.sources.corpus import FIELDS, materialised
from rankforge.sources.index import Index


# Fixed values of the okapi weight.
TF_OFFSET, TF_LENGTH = 0.5, 1.5
#: Up to so many best documents are a filter that reaches the files; more are joined.
FILTER_DOCS = 1000
#: Up to so many of their terms (a few MB) are broadcast.
BROADCAST_TERMS = 100_000


@dataclass(frozen=True)
class Feedback:
    algorithm: str  # okapi or rm3
    num_docs: int
    num_terms: int
    field_in: str = FIELDS[0]
    field_out: str = FIELDS[0]
    orig_weight: float | None = None

    @staticmethod
    def from_parameters(p: dict) -> Feedback:
        if p.get("type", "prf") != "prf":
            raise ValueError(f"unknown rewriter {p['type']!r}")
        if p["prf:algorithm"] not in ("okapi", "rm3"):
            raise ValueError(f"unknown feedback algorithm {p['prf:algorithm']!r}")
        weight = p.get("prf:rm3:origWeight")
        return Feedback(p["prf:algorithm"], int(p["prf:numDocs"]), int(p["prf:numTerms"]), p.get("prf:expansionFieldIn", FIELDS[0]), p.get("prf:expansionFieldOut", FIELDS[0]), None if weight is None else float(weight))


def term_scores(index: Index, ranking: DataFrame, f: Feedback) -> DataFrame:
    """(qid, term, score) of every term of each query's best documents; ranking(qid, docid, score, rank)."""
    spark = ranking.sparkSession
    rows = ranking.where(F.col("rank") <= f.num_docs).select("qid", "docid", "score", "rank").collect()
    best = spark.createDataFrame(rows, "qid string, docid long, score double, rank int")
    by_query = Window.partitionBy("qid")
    power = F.exp(F.col("score") - F.max("score").over(by_query))
    # Weights are shared among all best documents, those without terms too.
    best = best.withColumn("w", power).withColumn("w", F.col("w") / F.sum("w").over(by_query)).drop("score")
    usable = ~F.col("term").rlike(r"[.,]") & F.col("term").rlike(r"^[\x00-\x7F]*$")
    in_field, docids = F.col("field") == f.field_in, sorted({r.docid for r in rows})
    own = F.col("docid").isin(docids) if len(docids) <= FILTER_DOCS else F.lit(True)
    lengths = index.doc_len.where(in_field & own & (F.col("len_positions") > 0)).select("docid", F.col("len_positions").alias("length"))
    postings = index.postings if index.vectors is None else index.vectors
    found = postings.where(in_field & own & usable & (F.col("tf") > 0)).select("docid", "term", "tf")
    met = found.join(best, "docid").join(lengths, "docid")
    if f.algorithm == "okapi":
        # Document frequencies only of the terms that the best documents hold.
        if index.terms is not None:
            df = index.terms.where(in_field).select("term", "df").join(met.select("term").distinct(), "term", "left_semi")
        else:
            met = materialised(met)
            held = met.select("term").distinct()
            held = F.broadcast(held) if held.count() <= BROADCAST_TERMS else held
            df = index.doc_terms(f.field_in).join(held, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        tf = F.col("tf") / (F.col("tf") + TF_OFFSET + TF_LENGTH * F.col("length") / F.lit(index.stats(f.field_in).average))
        rsj = F.log((F.lit(float(index.num_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        each = met.join(df, "term").withColumn("s", tf * rsj)
    else:
        each = met.withColumn("s", F.col("tf") / F.col("length") * F.col("w"))
    # Sums in the order of ranks: the same whatever order rows arrive in.
    parts = each.groupBy("qid", "term").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("parts"))
    return parts.select("qid", "term", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))


def select_terms(scored: DataFrame, num_terms: int) -> DataFrame:
    """(qid, term, score, place): the best terms by score, then term; listed with the best one last."""
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "term"))
    listed = F.row_number().over(Window.partitionBy("qid").orderBy("score", "term"))
    return scored.withColumn("_r", best).where(F.col("_r") <= num_terms).drop("_r").withColumn("place", listed)


def learned_queries(selected: DataFrame, f: Feedback) -> DataFrame:
    """(qid, learned)."""
    term = F.col("term") if f.field_out == FIELDS[0] else F.concat(F.col("term"), F.lit(f".{f.field_out}"))
    if f.algorithm == "okapi":
        parts, head = term, "#sum ("
    else:
        total = F.sum("score").over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        share = F.col("score") / F.when(total > 0, total).otherwise(1.0)
        parts, head = F.format_string("%.6f %s", share, term), "#wsum ("
    rows = selected.select("qid", "place", parts.alias("part")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("p"))
    return rows.select("qid", F.concat(F.lit(head), F.array_join(F.transform("p", lambda x: x["part"]), " "), F.lit(")")).alias("learned"))


def expand(original: str, learned: str | None, f: Feedback) -> str:
    """The query that runs next. Nothing learned: the original."""
    if learned is None:
        return original
    if f.algorithm == "okapi" or f.orig_weight is None or f.orig_weight <= 0:
        return learned
    if f.orig_weight >= 1:
        return original
    return f"#wsum ({f.orig_weight} #sum ({original.strip()}) {1.0 - f.orig_weight} {learned})"


def rewrite(index: Index, queries: dict[str, str], ranking: DataFrame, f: Feedback) -> tuple[dict[str, str], dict[str, str]]:
    """(learned, expanded) queries by qid: a row for each query comes to the driver, where the next plan is made of it."""
    rows = learned_queries(select_terms(term_scores(index, ranking, f), f.num_terms), f).collect()
    found = {r.qid: r.learned for r in rows}
    learned = {qid: found.get(qid, q) for qid, q in queries.items()}
    return learned, {qid: expand(q, found.get(qid), f) for qid, q in queries.items()}
