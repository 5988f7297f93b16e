"""Shared pieces: table reading, staged tables that cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Names of our own columns beside a caller's.
ROW, KEY, KEY2 = "__rankforge_row", "__rankforge_key", "__rankforge_key2"


def identity(*columns: str) -> list[Column]:
    """Two 64-bit hashes that tell rows apart by the columns' values, null included; equal rows share them."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *reversed(columns))]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="rankforge-")
    spark.sparkContext.setCheckpointDir(base)
    return base


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of an action."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: What a batch of rows for Python may hold where the caller doesn't say: Spark's own 64 MB stand several times in each task, in the JVM and in Python.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python are of BATCH, unless it has a size of its own: for results that the caller writes."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH)


class Stage:
    """Tables written in the shared folder: an executor's loss costs no recomputation beyond the running job.

    Tables are removed when dropped or swept, and at the latest when the driver ends.
    """

    made: list[Stage] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/rankforge-{uuid.uuid4().hex}", {}
        Stage.made.append(self)

    @staticmethod
    def sweep(since: int) -> None:
        """Remove all tables of the stages made since so many there were: what was read of them has been written elsewhere."""
        for stage in Stage.made[since:]:
            p, fs = stage._path(stage.base)
            fs.delete(p, True)
        del Stage.made[since:]

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        # What was shuffled for a table is of no use once it stands; without this it stays until the driver collects garbage.
        # Batches of Python tasks are cut by size, since rows may hold long texts.
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(self.spark, BATCH_KEY, BATCH):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        p, fs = self._path(path)
        fs.deleteOnExit(p)
        self.paths[path] = True
        out._rankforge_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            p, fs = self._path(t._rankforge_path)
            fs.delete(p, True)


def release() -> None:
    """Give back what a reused Python worker keeps of earlier operators: encoders of words, and free memory."""
    import sys

    if bpe := sys.modules.get("rankforge.llm.bpe"):
        bpe._ENCODERS.clear()
    trim()


def trim() -> None:
    """Give back free memory, Arrow's and that of the C library, which keeps what was freed below the last block in use."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def components(stage: Stage, links: DataFrame) -> DataFrame:
    """Connected components of links(a, b): returns (node, component), component being the smallest node reachable.

    Alternating stars: every node tells its larger neighbours about the smallest node of its neighbourhood, then
    its smaller ones. All steps are joins and minimum aggregates, so a hub with a third of all links is combined
    map-side and its join side is split by AQE. Nodes are compared as they are (any orderable type); null nodes
    and self-links give no row. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage.write(edges, "edges")
    while True:
        # Large star: N(u) = all neighbours; v > u gets linked to min(N(u), u).
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u's smaller neighbours and u itself get linked to the smallest of them.
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        nxt = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        nxt = stage.write(nxt.where("u <> v").distinct(), "edges")
        # Done when every node has one parent and no parent has a parent.
        several = nxt.groupBy("u").count().where("count > 1").limit(1)
        deep = nxt.join(nxt.select(F.col("u").alias("p")).distinct(), F.col("v") == F.col("p"), "left_semi").limit(1)
        done = not several.select(F.lit(1)).union(deep.select(F.lit(1))).limit(1).take(1)
        stage.drop(edges)
        edges = nxt
        if done:
            break
    roots = edges.groupBy("v").agg(F.lit(1).alias("x")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def forest(n: int, pairs: Iterable) -> "object":
    """Smallest member of each index's component, for index pairs (two numpy arrays) of one task."""
    import numpy as np

    a, b = pairs
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not (label == (up := label[label])).all():
            label = up
        if (label == before).all():
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label
