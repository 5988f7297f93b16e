"""Text formats: query files, runs, judgements, expansion queries, metric files, side caches of an older index.

Readers are DataFrames over the lines; order in a file is kept by number. Writers give one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.sources.corpus import write_text

# Fixed values of the run format.
RUN_ID = "reference"
NO_DOCUMENT = "Nonexistent_Docid"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, n): the lines of one file in order. A run or query file is small enough for one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    last = F.max("n").over(Window.partitionBy())
    return lines.withColumn("last", last).where("line <> '' or n < last").select("line", "n")


def read_queries(spark: SparkSession, path: str) -> dict[str, str]:
    """qid:query by line. Text after a second colon is not part of the query; of equal qids the last one counts."""
    out = {}
    for n, line in enumerate(_driver_lines(spark, path), 1):
        parts = line.split(":")
        if len(parts) < 2:
            raise ValueError(f"{path}, line {n}: qid:query is wanted, not {line!r}")
        out[parts[0].strip()] = parts[1].strip()
    return out


def _driver_lines(spark: SparkSession, path: str) -> list[str]:
    rows = numbered_lines(spark, path).orderBy("n").collect()  # queries are parsed on the driver anyway
    return [r.line for r in rows]


def read_run(spark: SparkSession, path: str, max_rank: int | None = None) -> DataFrame:
    """(qid, ext_id, score, rank, n) of a run: six columns by white space. Where a qid comes again after others, its
    last stretch replaces those before; the file's order stays."""
    parts = F.split(F.trim("line"), r"\s+")
    lines = numbered_lines(spark, path).where("trim(line) <> ''").select("n", F.size(parts).alias("size"), parts.alias("p"))
    wrong = F.raise_error(F.concat(F.lit("a run's line has six columns, not: "), F.array_join("p", " ")))
    lines = lines.select("n", F.when(F.col("size") == 6, F.col("p")).otherwise(wrong.cast("array<string>")).alias("p"))
    rows = lines.select("n", F.col("p")[0].alias("qid"), F.col("p")[2].alias("ext_id"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[4].cast("double").alias("score"))
    by_line = Window.orderBy("n")
    rows = rows.withColumn("new", (F.lag("qid").over(by_line).isNull() | (F.lag("qid").over(by_line) != F.col("qid"))).cast("int"))
    rows = rows.withColumn("stretch", F.sum("new").over(by_line))
    rows = rows.withColumn("last", F.max("stretch").over(Window.partitionBy("qid"))).where("stretch = last")
    if max_rank is not None:
        rows = rows.where(F.col("rank") <= max_rank)
    return rows.select("qid", "ext_id", "score", "rank", "n")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, iter, ext_id, rel)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(p[0].alias("qid"), p[1].alias("iter"), p[2].alias("ext_id"), p[3].cast("int").alias("rel"))


def run_lines(ranking: DataFrame, qids: list[str], length: int, run_id: str = RUN_ID) -> DataFrame:
    """(place, rank, line): the lines of a run by order of queries; a query without documents gets a placeholder."""
    spark = ranking.sparkSession
    order = F.broadcast(spark.createDataFrame(list(enumerate(qids)), "place int, qid string"))
    found = ranking.where(F.col("rank") <= int(length)).join(order, "qid").select("place", "qid", "ext_id", "rank", "score")
    empty = order.join(found.select("qid").distinct(), "qid", "left_anti")
    empty = empty.select("place", "qid", F.lit(NO_DOCUMENT).alias("ext_id"), F.lit(1).alias("rank"), F.lit(0.0).alias("score"))
    line = F.format_string("%s Q0 %s %d %.12f %s", "qid", "ext_id", "rank", "score", F.lit(run_id))
    return found.unionByName(empty).select("place", "rank", line.alias("line"))


def write_run(ranking: DataFrame, qids: list[str], path: str, length: int, run_id: str = RUN_ID) -> None:
    """One file for evaluators; its rows are queries x length at most."""
    rows = run_lines(ranking, qids, length, run_id).orderBy("place", "rank")
    write_text(ranking.sparkSession, path, (r.line for r in rows.toLocalIterator()))


def write_expansion(spark: SparkSession, learned: dict[str, str], path: str) -> None:
    """qid: learned query by line."""
    write_text(spark, path, (f"{qid}: {q}" for qid, q in learned.items()))


def read_metrics(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(run, metric, qid, value) of a metric file: three columns, or two without a qid, which is then `all`."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(p.alias("p"))
    three = F.size("p") >= 3
    return rows.select(F.lit(run).alias("run"), F.col("p")[0].alias("metric"), F.when(three, F.col("p")[1]).otherwise(F.lit("all")).alias("qid"), F.element_at("p", -1).alias("value"))


def _zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, n): a gzipped file is one partition, whose rows are numbered from 0 in order."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("n"))


def read_length_cache(spark: SparkSession, path: str) -> DataFrame:
    """(docid, field, len_all) of a gzipped length cache: field names, corpus size, a row of lengths by document."""
    lines = _zipped_lines(spark, path)
    names, size = (r.line for r in lines.where("n < 2").orderBy("n").collect())
    rows = lines.where("n > 1 and trim(line) <> ''")
    if (there := rows.count()) != int(size):
        raise ValueError(f"{path}: {size} documents are announced, {there} are there")
    fields = F.array(*map(F.lit, names.strip().split(",")))
    lengths = rows.select((F.col("n") - 2).alias("docid"), F.explode(F.arrays_zip(fields.alias("f"), F.split(F.trim("line"), ",").alias("v"))).alias("x"))
    return lengths.select("docid", F.col("x.f").alias("field"), F.col("x.v").cast("int").alias("len_all"))


def read_id_cache(spark: SparkSession, path: str) -> DataFrame:
    """(docid, ext_id) of a gzipped id cache: a header, then an external id by line."""
    return _zipped_lines(spark, path).where("n > 0").select((F.col("n") - 1).alias("docid"), F.col("line").alias("ext_id"))
