"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Equal fingerprints are one
class; the distinct ones are laid out in cells by the population counts of their quarters (halves, for
radii over 2). Two fingerprints that differ in at most r bits have counts whose differences add up to at most r, so
cell pairs further apart are skipped and no link is lost. A cell is cut into tiles of about TILE fingerprints; every
pair of tiles that is left is compared with numpy exclusive-or and bit counts, and gives a spanning forest of its
links, so thousands of mutually near copies cost one row each, not one for each pair.

Defined results: a null or empty text has no shingle and fingerprint zero, and zero links like any other value;
repeated rows fall into one class; a null id is never a component's smallest unless all its ids are null; an empty
table gives an empty result; extra columns are not read, and keep_one passes them on whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm import jaccard
from rankforge.llm.common import KEY, KEY2, ROW, Stage, components, forest, identity, read

SHINGLE, RADIUS, TILE, SEED = 3, 2, 4096, 42


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a whole text's word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; without words it is zero."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        block = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. One row for each row of docs."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def parts_of(radius: int) -> int:
    """Into how many equal parts of a fingerprint population counts are taken: neighbouring cells must stay few."""
    return 4 if radius <= 2 else 2


def half_offsets(radius: int) -> list[list[int]]:
    """Differences of the parts' counts within the radius, one of each opposite pair, and zero."""
    steps, parts = range(-radius, radius + 1), parts_of(radius)
    return [list(d) for d in product(steps, repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts]


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between (or, if same, within) two tiles: members and their smallest one."""
    nodes = a if same else np.concatenate([a, b])
    order = np.argsort(nodes.view(np.int64), kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    found = []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 512, None] ^ b[None, :]) <= radius)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        else:
            j += len(a)
        i, j = place[i], place[j]
        if len(i) > len(nodes):  # a dense group: keep a spanning forest of the block
            low = forest(len(nodes), (i, j))
            i = np.flatnonzero(low != np.arange(len(nodes)))
            j = low[i]
        found.append((i, j))
    label = forest(len(nodes), tuple(map(np.concatenate, zip(*found))))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    nodes = nodes[order].view(np.int64)
    return nodes[moved], nodes[label[moved]]


def links(stage: Stage, classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links a-b that connect all distinct fingerprints classes(fp) within the radius, by exact tiled comparison."""
    width = 64 // parts_of(radius)
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1)))
    cell = F.array(*(count(k).cast("int") for k in range(64 // width)))
    cells = stage.write(classes.select("fp", cell.alias("cell")), "cells")
    # At most 17^4 cells, or 33^2, whatever the input: this table may be broadcast.
    n_tiles = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("n_tiles"))
    tiles = (
        cells.join(F.broadcast(n_tiles), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("n_tiles")).cast("int"))
        .groupBy("cell", "tile")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stage.write(tiles, "tiles")
    near = F.array(*(F.array(*map(F.lit, d)) for d in half_offsets(radius)))
    right = tiles.select(
        "cell", F.explode(F.transform(near, lambda d: F.zip_with("cell", d, lambda x, y: x + y))).alias("at"),
        F.col("tile").alias("tile_b"), F.col("fps").alias("b"),
    )
    left = tiles.select(F.col("cell").alias("at"), F.col("tile").alias("tile_a"), F.col("fps").alias("a"))
    pairs = (
        left.join(right, "at")
        .where((F.col("at") != F.col("cell")) | (F.col("tile_a") <= F.col("tile_b")))
        .select("a", "b", ((F.col("at") == F.col("cell")) & (F.col("tile_a") == F.col("tile_b"))).alias("same"))
    )

    def run(batches):
        for batch in batches:
            out = [(np.empty(0, np.int64),) * 2]
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
                out.append(compare(a, b, batch.column(2)[k].as_py(), radius))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) for each row of docs; component_id is the smallest id reachable over links."""
    stage = Stage(docs.sparkSession)
    fps = stage.write(fingerprints(docs, id_col, text_col, shingle), "fps")
    classes = stage.write(fps.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    found = stage.write(links(stage, classes, radius, tile), "links")
    parts = components(stage, found)
    # From components of fingerprints to their smallest id; a fingerprint without links is its own component.
    rooted = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    rooted = stage.write(rooted, "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(lows, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest doc_id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and chains of such
    texts. Links of fingerprints give the first pairs, but lose most below 0.95; a prefix filter finds the others, and
    every pair is verified by its sets (see jaccard).
    A row with a null doc_id stays only where its whole group has none; of equal ids one row stays.
    """
    key, key2 = identity("doc_id", "text")
    ids = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key.alias("key"), key2.alias("key2"))
    found = jaccard.classes_of(docs.select(ids.alias("id"), "text"), shingle, similarity)
    kept = found.where("id = component_id").select(F.col("id.key").alias(KEY), F.col("id.key2").alias(KEY2)).distinct()
    # Texts are shuffled once; the number within rows that are alike needs no other order.
    own = docs.withColumns({KEY: key, KEY2: key2}).join(kept, [KEY, KEY2], "left_semi")
    nth = F.row_number().over(Window.partitionBy(KEY, KEY2).orderBy(KEY))
    return own.withColumn(ROW, nth).where(F.col(ROW) == 1).select(*docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes_of(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
