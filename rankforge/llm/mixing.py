"""Mixing sources to target weights: cube-method balanced sampling.

Each source gets a target number of words; target / source size is the number of times that each of its documents
is taken on average. The whole part is taken by all its documents. The fractional part is an inclusion
probability, and the cube method decides who gets it: probabilities move through the null space of the balancing
constraints (document count, word count), so that both totals stay what they were, until every probability but
a few is 0 or 1. A source is cut into chunks of about CHUNK documents; at most RESERVE + 2 documents of each chunk
are left undecided and meet in the next round, until one chunk holds all that is left of a source. There the landing
tries all samples of the last RESERVE + 2 documents and takes the one nearest to the target.

Defined results: a null text has no words; a null source is a source of its own, ordered last; sources of size
zero have target zero; an empty table gives an empty result. Rows that repeat are decided one by one. Reruns
agree: all order and chance come from ids and texts. Where documents lack columns other than doc_id, text and
source nothing changes; extra columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import KEY, KEY2, ROW, Stage, identity, read

WORD = r"[^\x20\x09-\x0D]+"
CYCLE, SHARE, CAP, CHUNK, RESERVE = (3, 1, 2), 1.5, 2.0, 8192, 12
EPS = 1e-9
COPIES, ALIKE = "__rankforge_copies", "__rankforge_alike"


def targets(stage: Stage, sizes: DataFrame, cycle=CYCLE, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, n_docs, source_size, target) from sizes(source, size).

    Weights repeat over the sources in code point order. Only scalars come to the driver: sources are ranked by
    range partition, and each round of resharing is one aggregate.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = (F.col("source").isNull().cast("int"), F.col("source"))
    ranged = by.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = stage.write(ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order))), "sources")
    start, starts = 0, []  # one row for each partition, however many sources there are
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        starts.append((part, start))
        start += n
    firsts = stage.spark.createDataFrame(starts, "part int, first long")
    place = (F.col("first") + F.col("at") - 1) % len(cycle)
    weight = F.element_at(F.array(*map(F.lit, map(float, cycle))), (place + 1).cast("int"))
    ranged = ranged.join(F.broadcast(firsts), "part").select("source", "n_docs", "source_size", weight.alias("weight"))
    ranged = stage.write(ranged, "weights")
    total = share * (ranged.agg(F.sum("source_size")).first()[0] or 0)
    limit, level = F.col("source_size") * cap, 0.0
    while True:  # level: target for each unit of weight; it only rises, and with it the set of full sources
        full = F.col("weight") * level >= limit
        held, free = ranged.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free or (up := (total - (held or 0.0)) / free) <= level:
            break
        level = up
    return ranged.select("source", "n_docs", "source_size", F.least(F.col("weight") * level, limit).alias("target"))


def _move(pi: list[float], at: list[int], rng: random.Random, direction: tuple[float, ...]) -> None:
    """One step of the flight: along direction as far as the unit cube allows, one way or the other."""
    up = min((1 - pi[k]) / u if u > 0 else -pi[k] / u for k, u in zip(at, direction) if u)
    down = min(pi[k] / u if u > 0 else (pi[k] - 1) / u for k, u in zip(at, direction) if u)
    step = up if rng.random() * (up + down) < down else -down
    for k, u in zip(at, direction):
        x = pi[k] + step * u
        pi[k] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x


def _land(pi: list[float], size: list[int], at: list[int]) -> None:
    """The landing: of all samples of the few documents left, the one whose words, then count, come nearest."""
    picks = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    p, w = np.array([pi[k] for k in at]), np.array([size[k] for k in at], float)
    words, count = np.abs(picks @ w - p @ w), np.abs(picks.sum(1) - p.sum())
    best = picks[np.lexsort((count, np.round(words, 6)))[0]]
    for k, x in zip(at, best.tolist()):
        pi[k] = float(x)


def cube(pi: list[float], size: list[int], seed: str, land: bool) -> list[float]:
    """The probabilities after the flight, in the order given; after the landing too, if land.

    RESERVE documents spread over the sizes stay out of the flight, so that the landing, when it comes, has small and
    large ones to balance what flights leave.
    """
    rng, pi, open_ = random.Random(seed), list(pi), []
    unsure = [k for k in range(len(pi)) if 0 < pi[k] < 1]
    kept = unsure[:: -(-len(unsure) // RESERVE) or 1][:RESERVE] if unsure else []
    held = set(kept)
    for k in unsure:
        if k in held:
            continue
        open_.append(k)
        if len(open_) == 3:
            a, b, c = (size[x] for x in open_)
            # The null space of the rows (1, 1, 1) and (a, b, c); equal sizes leave any pair.
            _move(pi, open_, rng, (b - c, c - a, a - b) if not a == b == c else (1, -1, 0))
            open_ = [x for x in open_ if 0 < pi[x] < 1]
    if land and unsure:
        _land(pi, size, open_ + kept)
    return pi


def decide(docs: DataFrame, cycle=CYCLE, share: float = SHARE, cap: float = CAP, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, key, key2, size, source_size, target, copies) for each row of docs; keys are hashes of id and text."""
    if chunk < 4 * RESERVE:
        raise ValueError(f"a chunk has {4 * RESERVE} documents at least, or rounds would not shrink")
    stage = Stage(docs.sparkSession)
    key, key2 = identity("doc_id", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stage.write(docs.select("doc_id", "source", key.alias("key"), key2.alias("key2"), size.alias("size")), "sizes")
    shares = stage.write(targets(stage, sizes, cycle, share, cap).withColumnRenamed("source", "s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(shares, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    whole = F.floor(F.col("rate") + EPS)
    rows = rows.withColumn("copies", whole).withColumn("pi", F.when(F.abs(F.col("rate") - whole) < EPS, 0.0).otherwise(F.col("rate") - whole))
    columns = ["doc_id", "source", "key", "key2", "size", "source_size", "target", "copies", "pi"]
    left = rows.withColumn("n", F.col("n_docs")).select(*columns, "n")
    schema = left.drop("n").schema
    decided, level = None, 0
    while True:
        chunks = F.ceil(F.col("n") / chunk)
        deal = F.pmod(F.xxhash64("key", F.lit(level)), chunks)
        dealt = left.withColumn("n_chunks", chunks).withColumn("chunk", deal)

        def run(key, table):
            table = table.sort_by([("size", "descending"), ("key", "ascending"), ("key2", "ascending")])
            land = table.column("n_chunks")[0].as_py() == 1
            seed = f"{key[0].as_py()}|{key[1].as_py()}|{level}"
            pi = cube(table.column("pi").to_pylist(), table.column("size").to_pylist(), seed, land)
            return table.set_column(table.column_names.index("pi"), "pi", pa.array(pi, pa.float64())).select(columns)

        done = stage.write(dealt.groupBy("source", "chunk").applyInArrow(run, schema), "flown")
        over = F.col("pi").isin(0.0, 1.0)
        part = done.where(over)
        decided = part if decided is None else decided.union(part)
        rest = done.where(~over)
        counts = rest.groupBy("source").count().withColumnsRenamed({"source": "s", "count": "n"})
        if not rest.limit(1).take(1):
            break
        left = rest.join(counts, F.col("source").eqNullSafe(F.col("s"))).select(*columns, "n")
        level += 1
    return decided.select("doc_id", "source", "key", "key2", "size", "source_size", "target", (F.col("copies") + F.col("pi").cast("long")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix: each row of docs as many times as decide() takes it (0, 1 or 2 times at the usual cap)."""
    taken = decide(docs, **how).groupBy("key", "key2").agg(F.sum("copies").alias(COPIES), F.count("*").alias(ALIKE))
    key, key2 = identity("doc_id", "text")
    own = docs.withColumns({KEY: key, KEY2: key2}).join(taken.withColumnsRenamed({"key": KEY, "key2": KEY2}), [KEY, KEY2])
    # Rows that are alike share their copies evenly; the first of them take what is over.
    nth = F.row_number().over(Window.partitionBy(KEY, KEY2).orderBy(KEY))
    times = F.floor(F.col(COPIES) / F.col(ALIKE)) + (F.col(ROW) <= F.col(COPIES) % F.col(ALIKE)).cast("long")
    out = own.withColumn(ROW, nth).withColumn(COPIES, times).where(F.col(COPIES) > 0)
    return out.withColumn(ROW, F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES)))).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = decide(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
