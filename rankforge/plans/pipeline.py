"""Parameter-driven pipelines: tasks in the order of the file, each taking and giving the whole batch of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.operators import models, prf
from rankforge.operators.rank import rank
from rankforge.operators.rerank import Scorer, rerank
from rankforge.sources import trec
from rankforge.sources.index import Index
from rankforge.sources.params import read_parameters

DEPTH = 1000


@dataclass(frozen=True)
class Batch:
    """Queries by qid in order, the current ranking (qid, docid, ext_id, score, rank) of all, and what feedback learned."""

    queries: dict[str, str]
    ranking: DataFrame | None = None
    learned: dict[str, str] | None = None


def kind_of(name: str) -> str:
    """task_2:rewriter is a rewriter: the number is not used."""
    return name.split(":", 1)[1] if ":" in name else ""


def output_length(params: dict) -> int:
    """The length of the first trec_eval task that has one."""
    lengths = [p["outputLength"] for k, p in params.items() if kind_of(k) == "output" and p.get("type") == "trec_eval" and "outputLength" in p]
    return int(lengths[0]) if lengths else DEPTH


def run_ranker(index: Index, batch: Batch, p: dict, limit: int) -> Batch:
    if p.get("type") == "inRankFile":
        return replace(batch, ranking=read_ranking(index, batch.queries, p["inRankFile:Path"]))
    depth = min(int(p.get("outputLength", DEPTH)), limit)
    return replace(batch, ranking=rank(index, batch.queries, models.from_parameters(p), depth))


def read_ranking(index: Index, queries: dict[str, str], path: str) -> DataFrame:
    """A run's documents in file order, whatever their number; a query that is not in the batch is an error."""
    spark = index.docs.sparkSession
    run = trec.read_run(spark, path)
    unknown = [r.qid for r in run.select("qid").distinct().collect() if r.qid not in queries]  # a run of a batch
    if unknown:
        raise KeyError(f"{path} has queries that are not in the batch: {', '.join(sorted(unknown))}")
    # A document's rank is its place in the file, whatever the file says.
    place = F.row_number().over(Window.partitionBy("qid").orderBy("n"))
    run = run.withColumn("rank", place)
    return run.join(index.docs.select("docid", "ext_id"), "ext_id", "left").select("qid", "docid", "ext_id", "score", "rank")


def run_rewriter(index: Index, batch: Batch, p: dict) -> Batch:
    if batch.ranking is None:
        raise ValueError("a rewriter needs a ranking")
    learned, expanded = prf.rewrite(index, batch.queries, batch.ranking, prf.Feedback.from_parameters(p))
    if "prf:expansionQueryFile" in p:
        trec.write_expansion(index.docs.sparkSession, learned, p["prf:expansionQueryFile"])
    return replace(batch, queries=expanded, learned=learned)


def run_output(batch: Batch, p: dict) -> None:
    if p["type"] != "trec_eval":
        raise ValueError(f"unknown output {p['type']!r}")
    trec.write_run(batch.ranking, list(batch.queries), p["outputPath"], int(p["outputLength"]))


def run(spark: SparkSession, params: dict | str, index: Index | None = None, scorers: dict[str, Scorer] | None = None) -> Batch:
    """Run a parameter file, or its content. scorers: by the type of a reranker."""
    params = read_parameters(params) if isinstance(params, str) else params
    index = index or Index.open(spark, params["indexPath"])
    batch = Batch(trec.read_queries(spark, params["queryFilePath"]))
    limit = output_length(params)
    for name, p in params.items():
        if not isinstance(p, dict):
            continue
        kind = kind_of(name)
        if kind == "ranker":
            batch = run_ranker(index, batch, p, limit)
        elif kind == "rewriter":
            batch = run_rewriter(index, batch, p)
        elif kind == "reranker":
            scorer = (scorers or {}).get(p.get("type"))
            if scorer is None:
                raise ValueError(f"no scorer for reranker {p.get('type')!r}")
            batch = replace(batch, ranking=rerank(batch.ranking, scorer, int(p.get("rerankDepth", DEPTH))))
        elif kind == "output":
            run_output(batch, p)
        else:
            raise ValueError(f"unknown task {name!r}")
    return batch
