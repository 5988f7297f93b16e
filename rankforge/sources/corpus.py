"""Corpora: documents with named text fields and stored attributes, as two DataFrames.

docs(docid, ext_id, attrs) and fields(docid, field, text); docid is the order in ties, ext_id is unique.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fields that queries may name; the first is the default.
FIELDS = ("body", "title", "url", "keywords", "inlink")


@dataclass(frozen=True)
class Corpus:
    docs: DataFrame
    fields: DataFrame


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="rankforge-"))
    return context.getCheckpointDir()


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    p, fs = _path(spark, f"{shared_folder(spark)}/rankforge-{uuid.uuid4().hex}")
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return p.toString()


def write_text(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """One text file in any file system that Spark reaches."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        block: list[str] = []
        for line in lines:
            block.append(f"{line}\n")
            if len(block) == 10_000:
                out.write(bytearray("".join(block).encode()))
                block.clear()
        out.write(bytearray("".join(block).encode()))
    finally:
        out.close()


def materialised(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def from_documents(table: DataFrame) -> Corpus:
    """documents(doc_id, text, lang, source): text is the body."""
    docid = F.col("doc_id").cast("long").alias("docid")
    ext = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("ext_id")
    attrs = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source")).alias("attrs")
    return Corpus(table.select(docid, ext, attrs), table.select(docid, F.lit("body").alias("field"), "text"))


def from_pages(table: DataFrame) -> Corpus:
    """pages(page_id, url, html): url, the page's title, and the text without markup as the body."""
    docid = F.col("page_id").cast("long").alias("docid")
    ext = F.concat(F.lit("page-"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("ext_id")
    attrs = F.map_from_arrays(F.array(F.lit("url")), F.array("url")).alias("attrs")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", " "), r"<[^>]*>", " ")
    texts = F.array(*(F.struct(F.lit(f).alias("field"), t.alias("text")) for f, t in (("url", F.col("url")), ("title", title), ("body", body))))
    fields = table.select(docid, F.explode(texts).alias("f")).select("docid", "f.field", "f.text")
    return Corpus(table.select(docid, ext, attrs), fields)


def from_frame(table: DataFrame, ext_id: str, fields: dict[str, str], attrs: list[str] | None = None) -> Corpus:
    """Any table: docids by order of the external id; fields maps field names to columns.

    Ids are numbered by range partitions and their sizes, so no task sees all rows.
    """
    spark: SparkSession = table.sparkSession
    ranged = materialised(table.repartitionByRange(F.col(ext_id)).withColumn("_part", F.spark_partition_id()))
    firsts, start = [], 0
    for part, n in sorted(ranged.groupBy("_part").count().collect()):  # a row for each partition
        firsts.append((part, start))
        start += n
    numbers = spark.createDataFrame(firsts, "_part int, _first long")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(ext_id))
    rows = ranged.withColumn("_at", at).join(F.broadcast(numbers), "_part").withColumn("docid", F.col("_first") + F.col("_at") - 1)
    stored = attrs or []
    kept = F.map_from_arrays(F.array(*map(F.lit, stored)), F.array(*(F.col(a).cast("string") for a in stored))) if stored else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    texts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in fields.items()))
    docs = rows.select("docid", F.col(ext_id).alias("ext_id"), kept.alias("attrs"))
    return Corpus(docs, rows.select("docid", F.explode(texts).alias("f")).select("docid", "f.field", "f.text"))
