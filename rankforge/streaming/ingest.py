"""Incremental indexing: each micro-batch of new documents becomes a segment of an index.

A batch is written to a folder of its number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankforge.functions.analysis import Analyzer
from rankforge.sources.corpus import Corpus
from rankforge.sources.index import Index


def index_stream(documents: DataFrame, path: str, checkpoint: str, corpus_of, analyzer: Analyzer | None = None) -> StreamingQuery:
    """Start indexing a streaming DataFrame; corpus_of makes a Corpus of a batch. Document ids must not come again."""

    def add(batch: DataFrame, number: int) -> None:
        corpus: Corpus = corpus_of(batch)
        Index.build(corpus, analyzer).write(f"{path}/segment={number}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_segments(spark: SparkSession, path: str, numbers: list[int], analyzer: Analyzer | None = None) -> Index:
    """One index over segments: documents are disjoint, so tables are unions and statistics follow."""
    parts = [Index.open(spark, f"{path}/segment={n}", analyzer) for n in numbers]
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    terms = union([p.terms for p in parts]).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
    return Index(*(union([getattr(p, t) for p in parts]) for t in ("docs", "doc_len", "postings")), analyzer or Analyzer(), union([p.vectors for p in parts]), terms)
