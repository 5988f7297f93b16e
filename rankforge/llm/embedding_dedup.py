"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a random rotation (fixed by the dimension alone) the
coordinates are split into BLOCKS blocks; each gets a part of the squared distance in proportion to its dimensions,
and two vectors within the whole must be within the part of at least one block. Each block is a range join: a grid
over the block's first coordinate, twice as wide as the block's radius, where every vector also visits the
neighbouring cells that its ball reaches (one of two neighbours visits the other). Cells are cut into tiles of about
TILE vectors; a task takes two tiles, filters by the block's squared distances and verifies what is left by the
cosine in double precision. A link counts in the first block whose budget it meets, so it counts once.

Tasks send sums of links for each vector and a spanning forest, never pairs: a group of thousands of mutual links
costs a row for each member and tile pair. Equal vectors are one class from the start.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and stay;
vectors of different lengths don't link; repeated rows link with each other and count one by one; a null vec_id is
never the smallest of a component that has others; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Stage, components, forest, read

COSINE, BLOCKS, GRID, TILE = 0.95, 4, 1, 1024
#: What rounding to single precision may add to a block's squared distance.
SLACK = 1e-5


def sound(vector: Column) -> Column:
    """Whether a vector takes part: not null or zero, all its components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, blocks: int = BLOCKS) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), min(blocks, dim))


def units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def place(classes: DataFrame, cosine: float) -> DataFrame:
    """classes(cid, n, vector) in every cell they live in or visit: (dim, block, cell, visit, cid, n, raw, turned)."""
    double = classes.schema["vector"].dataType.elementType.typeName() == "double"

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            lists = b.column(2)
            sizes = np.asarray(lists.value_lengths())
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            out = {k: [] for k in ("dim", "block", "cell", "visit", "row", "raw", "turned")}
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                raw = flat[offsets[rows][:, None] + np.arange(dim)]
                turn = turns.setdefault(dim, rotation(dim))
                turned = (units(raw) @ turn).astype(np.float32)
                for block, axes in enumerate(blocks_of(dim)):
                    radius = math.sqrt((2 - 2 * cosine) * len(axes) / dim + SLACK)
                    x = turned[:, axes[:GRID]].astype(np.float64) / (2 * radius)
                    home = np.floor(x).astype(np.int64)
                    for step in np.ndindex(*(3,) * x.shape[1]):
                        step = np.array(step) - 1
                        if tuple(step) < (0,) * len(step):
                            continue
                        # Squared distance to the neighbouring cell in units of the cell width; the radius is half of one.
                        gap = np.where(step > 0, home + 1 - x, np.where(step < 0, x - home, 0.0))
                        reach = np.flatnonzero((gap * gap).sum(1) <= 0.25 + 1e-9)
                        out["dim"].append(np.full(len(reach), dim))
                        out["block"].append(np.full(len(reach), block))
                        out["cell"].extend(map(",".join, (home[reach] + step).astype(str)))
                        out["visit"].append(np.full(len(reach), bool(step.any())))
                        out["row"].append(rows[reach])
                        out["raw"].extend(r.tobytes() for r in raw[reach])
                        # Of the rotated vector, what the blocks up to this one need.
                        out["turned"].extend(r.tobytes() for r in turned[reach, : axes[-1] + 1])
            if not out["row"]:
                continue
            row = np.concatenate(out["row"])
            ints = [pa.array(np.concatenate(out[k]).astype(np.int32)) for k in ("dim", "block")]
            yield pa.RecordBatch.from_arrays(
                [*ints, pa.array(out["cell"], pa.string()), pa.array(np.concatenate(out["visit"])), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(out["raw"], pa.binary()), pa.array(out["turned"], pa.binary())],
                names=["dim", "block", "cell", "visit", "cid", "n", "raw", "turned"],
            )

    source = classes.select("cid", "n", F.col("vector").cast("array<double>" if double else "array<float>").alias("vector"))
    return source.mapInArrow(run, "dim int, block int, cell string, visit boolean, cid long, n long, raw binary, turned binary")


def _bytes(values: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values, one after another, as they lie in the batch."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


class Tile:
    def __init__(self, cid, n, raw, turned, dim: int, kind: type):
        self.cid, self.n = cid.values.to_numpy(), n.values.to_numpy()
        self.unit = units(_bytes(raw.values).view(kind).reshape(-1, dim))
        self.turned = _bytes(turned.values).view(np.float32).reshape(len(self.cid), -1)


def compare(a: Tile, b: Tile, same: bool, block: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Between two tiles, or within one: classes with their numbers of new links, and a spanning forest (child, parent)."""
    parts = blocks_of(dim)
    budget = [(2 - 2 * cosine) * len(p) / dim + SLACK for p in parts]
    x, y = a.turned[:, parts[block]], b.turned[:, parts[block]]
    # With the squares among the columns a squared distance is one product: (-2x, xx, 1) times (y, 1, yy).
    one = lambda v: np.ones((len(v), 1), np.float32)
    square = lambda v: (v * v).sum(1, keepdims=True)
    x, y = np.hstack([-2 * x, square(x), one(x)]), np.hstack([y, one(y), square(y)]).T.copy()
    size = len(a.cid) + (0 if same else len(b.cid))
    links, left, right = np.zeros(size, np.int64), [], []
    for at in range(0, len(x), 256):
        # Single precision finds the candidates; a little more room keeps all of them.
        i, j = np.divmod(np.flatnonzero(x[at : at + 256] @ y <= budget[block] + SLACK), y.shape[1])
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        rows, place_ = np.unique(i, return_inverse=True)
        ok = (a.unit[rows] @ b.unit.T)[place_, j] >= cosine
        i, j = i[ok], j[ok]
        for lo in range(0, len(i), 65536):
            p, q = i[lo : lo + 65536], j[lo : lo + 65536]
            first = np.ones(len(p), bool)
            for k, axes in enumerate(parts[: block + 1]):
                diff = a.turned[p][:, axes].astype(np.float64) - b.turned[q][:, axes]
                within = (diff * diff).sum(1) <= budget[k]
                first &= within if k == block else ~within
            p, q = p[first], q[first]
            q_at = q if same else q + len(a.cid)
            links += np.bincount(p, b.n[q], size).astype(np.int64) + np.bincount(q_at, a.n[p], size).astype(np.int64)
            if len(p) > size:
                low = forest(size, (p, q_at))
                p = np.flatnonzero(low != np.arange(size))
                q_at = low[p]
            left.append(p)
            right.append(q_at)
    cid = a.cid if same else np.concatenate([a.cid, b.cid])
    if not left:
        return (np.empty(0, np.int64),) * 3
    low = forest(size, (np.concatenate(left), np.concatenate(right)))
    some = np.flatnonzero(links)
    return cid[some], cid[low[some]], links[some]


def links(stage: Stage, classes: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(a, b, n): class a has n new links, and is connected with class b; over classes(cid, n, vector)."""
    placed = stage.write(place(classes, cosine), "placed")
    key = ["dim", "block", "cell"]
    n_tiles = placed.groupBy(*key, "visit").agg(F.ceil(F.count("*") / tile).cast("int").alias("n_tiles"))
    tiles = (
        placed.join(n_tiles, [*key, "visit"])
        .withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("n_tiles")).cast("int"))
        .groupBy(*key, "visit", "tile")
        .agg(*(F.collect_list(c).alias(c) for c in ("cid", "n", "raw", "turned")))
    )
    tiles = stage.write(tiles, "tiles")
    columns = ("tile", "cid", "n", "raw", "turned")
    home = tiles.where("not visit").select(*key, *(F.col(c).alias(f"a_{c}") for c in columns))
    pairs = tiles.select(*key, "visit", *(F.col(c).alias(f"b_{c}") for c in columns)).join(home, key)
    pairs = pairs.where("visit or a_tile <= b_tile").select("dim", "block", (~F.col("visit") & (F.col("a_tile") == F.col("b_tile"))).alias("same"), *(f"{s}_{c}" for s in "ab" for c in columns[1:]))
    kind = np.float64 if classes.schema["vector"].dataType.elementType.typeName() == "double" else np.float32

    def run(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                dim, block, same = (b.column(c)[0].as_py() for c in range(3))
                left, right = (Tile(*(b.column(f"{s}_{c}")[0] for c in columns[1:]), dim, kind) for s in "ab")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in compare(left, right, same, block, dim, cosine)], names=["a", "b", "n"])

    return stage.write(pairs.mapInArrow(run, "a long, b long, n long"), "links")


def dedup(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    stage = Stage(vectors.sparkSession)
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(sound(v), v).alias("vector"))
    grouped = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = stage.write(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = links(stage, classes, cosine, tile)
    parts = components(stage, found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    rooted = classes.select("cid", "low", "n", "vector").join(parts.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    rooted = stage.write(rooted.select("vector", "low", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("root")), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_vector = rooted.join(lows, "root").select(F.col("vector").alias("v"), "n_links", "component_id")
    out = rows.join(by_vector, F.col("vector") == F.col("v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "embeddings"))
