"""Inspection of an index: one function for each thing that can be listed."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.sources.index import Index


def check_docid(index: Index, docid: int) -> None:
    if not index.docs.where(F.col("docid") == docid).take(1):
        raise ValueError(f"no document {docid}")


def list_attribute(index: Index, docid: int, name: str) -> DataFrame:
    return index.docs.where(F.col("docid") == docid).select("docid", F.element_at("attrs", F.lit(name)).alias("value"))


def list_doc(index: Index, docid: int) -> DataFrame:
    check_docid(index, docid)
    return index.docs.where(F.col("docid") == docid)


def list_docids(index: Index) -> DataFrame:
    return index.docs.select("docid", "ext_id").orderBy("docid")


def list_external(index: Index, docid: int) -> DataFrame:
    return index.docs.where(F.col("docid") == docid).select("docid", "ext_id")


def list_internal(index: Index, ext_id: str) -> DataFrame:
    return index.docs.where(F.col("ext_id") == ext_id).select("docid", "ext_id")


def list_fields(index: Index) -> DataFrame:
    return index.doc_len.select("field").distinct().orderBy("field")


def list_metadata(index: Index, docid: int) -> DataFrame:
    check_docid(index, docid)
    return index.docs.where(F.col("docid") == docid).select(F.explode("attrs").alias("name", "value")).orderBy("name")


def list_postings(index: Index, term: str, field: str, sample: int | None = None) -> DataFrame:
    """Postings by docid; sample: the first so many."""
    rows = index.posting_list(term, field).select("docid", "tf", "positions").orderBy("docid")
    return rows if sample is None else rows.limit(sample)


def list_postings_head(index: Index, term: str, field: str) -> DataFrame:
    """(df, ctf)."""
    return index.posting_list(term, field).agg(F.count("*").alias("df"), F.coalesce(F.sum("tf"), F.lit(0)).alias("ctf"))


def list_stats(index: Index) -> DataFrame:
    """(field, doc_count, total, average)."""
    by = index.doc_len.groupBy("field").agg(F.count(F.when(F.col("n_indexed") > 0, 1)).alias("doc_count"), F.sum("n_indexed").alias("total"))
    return by.withColumn("average", F.when(F.col("total") > 0, F.col("total") / F.col("doc_count")).otherwise(1.0))


def list_terms(index: Index, field: str) -> DataFrame:
    return index.term_stats().where(F.col("field") == field).select("term", "df", "ctf").orderBy("term")


def list_term_vector(index: Index, docid: int, field: str | None = None) -> DataFrame:
    if field is None:
        check_docid(index, docid)
    return index.term_vector(docid, field).select("field", "term", "tf", "positions")


def main(spark: SparkSession, argv: list[str]) -> None:
    """Flags in the order given, each printing what it lists."""
    p = argparse.ArgumentParser()
    p.add_argument("-index", required=True)
    flags = {
        "list-attribute": (2, lambda i, a: list_attribute(i, int(a[0]), a[1])), "list-doc": (1, lambda i, a: list_doc(i, int(a[0]))), "list-docids": (0, lambda i, a: list_docids(i)),
        "list-edocid": (1, lambda i, a: list_external(i, int(a[0]))), "list-fields": (0, lambda i, a: list_fields(i)), "list-idocid": (1, lambda i, a: list_internal(i, a[0])),
        "list-metadata": (1, lambda i, a: list_metadata(i, int(a[0]))), "list-postings": (2, lambda i, a: list_postings(i, a[0], a[1])), "list-postings-sample": (2, lambda i, a: list_postings(i, a[0], a[1], 5)),
        "list-stats": (0, lambda i, a: list_stats(i)), "list-terms": (1, lambda i, a: list_terms(i, a[0])), "list-termvector": (1, lambda i, a: list_term_vector(i, int(a[0]))),
        "list-termvector-field": (2, lambda i, a: list_term_vector(i, int(a[0]), a[1])),
    }
    own, rest = p.parse_known_args(argv)
    index = Index.open(spark, own.index)
    while rest:
        name = rest.pop(0).lstrip("-")
        if name not in flags:
            raise ValueError(f"unknown flag -{name}")
        n, show = flags[name]
        args, rest = rest[:n], rest[n:]
        print(f"-{name}", *args)
        show(index, args).show(1_000_000, truncate=False)
