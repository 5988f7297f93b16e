"""Near copies by the exact similarity of shingle sets: all pairs with a Jaccard similarity of at least a threshold.

Texts with equal sets are one class. Pairs of classes come from three places, and every one is verified by whole sets:
the links of their SimHash fingerprints (tiled exact comparison, see simhash), which join most copies; then a prefix filter,
which misses none. For it shingles have one order for all classes, seldom ones first; two sets of similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each, whatever the order is. The order comes from the counts of all
shingles of all documents: their keys go, packed, to the bucket that counts them, and those that stand in several
documents come back to theirs. A shingle of one document meets nothing, so only its number in a set is needed.

Each class meets, for each shingle of its prefix, the class of about its size in which that shingle stands first: of the
copies of a text the one with the fewest changes, which is alike to all that are alike to any. So a large group of near
copies costs two rows for each shingle at most, not one for each pair; with a class that says nothing of its changes, as the smallest
hash, most links of a group may be left over. Then the classes of a shingle that are still in different components meet each other,
except where too many shingles must differ: by their sizes, by the parities of the shingles in each of BITS parts
(each different shingle turns one), or by what comes after the shingle in either order, which has to hold all others that
they share if it is the first one. Pairs to verify are dealt in tiles, so a set goes to a tile once, not to each of its pairs.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Stage, components, release

#: Characters of text for each bucket that counts shingles, documents packed together at most, and classes on a tile's side.
BUCKET, PACK, TILE = 1 << 23, 2048, 64
BITS = 1024
_ODD = [f"odd{k}" for k in range(BITS // 64)]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    from rankforge.llm.simhash import shingle_hashes

    return np.unique(shingle_hashes(text, shingle))


def keys_of(s: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket that counts each shingle and its key there; the order needs no more of a hash than these."""
    return ((s >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32), s.astype(np.uint32)


def packed(sets: list[np.ndarray], n_buckets: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, owners, keys) of each bucket that gets shingles of the sets; owners are steps, in one or in two bytes each."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    bucket, key = keys_of(np.concatenate([np.empty(0, np.uint64), *sets]), n_buckets)
    order = np.argsort(bucket, kind="stable")
    owner, bucket, key = owner[order], bucket[order], key[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = []
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
        steps = np.diff(owner[i:j], prepend=0)
        out.append((int(bucket[i]), steps.astype(np.uint8 if steps.max() < 256 else np.uint16).tobytes(), key[i:j].tobytes()))
    return out


def unpacked(owners: bytes, n: int) -> np.ndarray:
    """The owners of n keys."""
    return np.cumsum(np.frombuffer(owners, np.uint8 if len(owners) == n else np.uint16), dtype=np.int64)


def prefixes(sizes: np.ndarray, owner: np.ndarray, key: np.ndarray, count: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, key) of the shared shingles in the prefixes of sets of these sizes, by owner and place.

    Given are all shingles that several documents hold; the others of a set come first, whichever they are.
    """
    t, u = similarity.numerator, similarity.denominator
    order = np.lexsort((key, count, owner))
    owner, key = owner[order], key[order]
    shared = np.bincount(owner, minlength=len(sizes))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(shared) - shared, shared) + (sizes - shared)[owner]
    there = at < (sizes - -(-t * sizes // u) + 1)[owner]
    return owner[there], at[there], key[there]


def parities(s: np.ndarray) -> np.ndarray:
    """Whether a set's shingles are odd in number, for each of BITS parts, as signed longs."""
    odd = np.bincount((s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def verified(stage: Stage, pairs: DataFrame, sets: DataFrame, similarity: Fraction, name: str) -> DataFrame:
    """Those of pairs(a, b, g) whose sets(cls, grams) are alike; pairs of a group g are compared tile by tile."""
    sides = pairs.groupBy("g").agg(F.ceil(F.greatest(F.approx_count_distinct("a"), F.approx_count_distinct("b")) / TILE).alias("n"))
    tile = lambda c: F.pmod(F.xxhash64(c, F.lit("tile")), F.col("n")).alias(f"t{c}")
    tiled = stage.write(pairs.join(sides, "g").select("g", tile("a"), tile("b"), "a", "b"), "tiled")
    needed = tiled.select(F.col("g").alias("of"), F.col("ta").alias("x"), F.col("tb").alias("y"), F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets, "cls")
    t, u = similarity.numerator, similarity.denominator

    def run(left, right):
        grams = {c: np.frombuffer(s.as_py(), np.uint64) for c, s in zip(right.column("cls").to_pylist(), right.column("grams"))}
        keep = []
        for k, (a, b) in enumerate(zip(left.column("a").to_pylist(), left.column("b").to_pylist())):
            x, y = grams[a], grams[b]
            equal = len(x) + len(y) - len(np.union1d(x, y))
            if equal * u >= t * (len(x) + len(y) - equal):
                keep.append(k)
        return left.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    found = tiled.groupBy("g", "ta", "tb").cogroup(needed.groupBy("of", "x", "y")).applyInArrow(run, "a long, b long")
    found = stage.write(found, name)
    stage.drop(tiled)
    return found


def sketched(docs: DataFrame, shingle: int, n_buckets: int) -> DataFrame:
    """(id, cls, n, fp, odd) of docs(id, text): class, size, fingerprint and parities of each set; and their shingles for the buckets.

    A row for each bucket of a pack of documents has bucket, owners and keys; one with bucket -1 has the documents' classes and sizes.
    """
    from rankforge.llm.simhash import majority, shingle_hashes

    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "cls", "n", "fp", *_ODD, "pack", "bucket", "owners", "keys"]

    def run(batches):
        release()
        for whole in batches:
            for start in range(0, whole.num_rows, PACK):
                b = whole.slice(start, PACK)
                sets, fp, odd = [], [], []
                for t in b.column(1):
                    h = shingle_hashes(t.as_py(), shingle)
                    sets.append(np.unique(h))
                    fp.append(majority(h))
                    odd.append(parities(sets[-1]))
                n = np.array(list(map(len, sets)), np.int64)
                cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                longs = [pa.array(x) for x in np.array(odd, np.int64).reshape(-1, len(_ODD)).T.copy()]
                none = [pa.nulls(len(n), x) for x in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls), pa.array(n), pa.array(np.array(fp, np.uint64).view(np.int64)), *longs, *none], names=names)
                bucket, owners, keys = zip((-1, cls.tobytes(), n.tobytes()), *packed(sets, n_buckets))
                none = [pa.nulls(len(bucket), x) for x in (b.column(0).type, *[pa.int64()] * (3 + len(_ODD)))]
                pack = pa.array([uuid.uuid4().int >> 65] * len(bucket), pa.int64())
                yield pa.RecordBatch.from_arrays([*none, pack, pa.array(bucket, pa.int32()), pa.array(owners, pa.binary()), pa.array(keys, pa.binary())], names=names)

    longs = ", ".join(f"{w} long" for w in _ODD)
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, cls long, n long, fp long, {longs}, pack long, bucket int, owners binary, keys binary")


def shared_prefixes(stage: Stage, packs: DataFrame, similarity: Fraction) -> DataFrame:
    """(cls, pos, gram, size): of each class the shingles of its prefix that other documents hold as well, from all packs(pack, bucket, owners, keys)."""

    def count(key, table):
        table = table.combine_chunks()
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        n, ends = n[at], np.cumsum([0, *map(len, keys)])
        out = []
        for k, (owners, own) in enumerate(zip(table.column("owners"), keys)):
            of = n[ends[k] : ends[k + 1]]
            several = np.flatnonzero(of > 1)
            owner = unpacked(owners.as_py(), len(own))[several].astype(np.uint16)
            out.append((owner.tobytes(), own[several].tobytes(), np.minimum(of[several], 0xFFFFFFFF).astype(np.uint32).tobytes()))
        binary = [pa.array(x, pa.binary()) for x in zip(*out)]
        return pa.table([table.column("pack"), table.column("bucket"), *binary], names=["pack", "bucket", "owners", "keys", "counts"])

    form = "pack long, bucket int, owners binary, keys binary, counts binary"
    counted = packs.where("bucket >= 0").groupBy("bucket").applyInArrow(count, form)
    counted = stage.write(counted.where(F.length("keys") > 0), "counted")

    def gather(key, table):
        rows = table.to_pylist()
        cls, sizes = next((np.frombuffer(r["owners"], np.int64), np.frombuffer(r["keys"], np.int64)) for r in rows if r["bucket"] < 0)
        rows = [r for r in rows if r["bucket"] >= 0]
        owner, low, n = (np.concatenate([np.empty(0, kind), *(np.frombuffer(r[c], kind) for r in rows)]) for c, kind in (("owners", np.uint16), ("keys", np.uint32), ("counts", np.uint32)))
        high = np.repeat(np.array([r["bucket"] for r in rows], np.int64), [len(r["counts"]) // 4 for r in rows])
        owner, at, gram = prefixes(sizes, owner.astype(np.int64), high << 32 | low.astype(np.int64), n, similarity)
        # Of equal sets in a pack one goes on.
        first = np.zeros(len(cls), bool)
        first[np.unique(cls, return_index=True)[1]] = True
        keep = first[owner]
        return pa.table([pa.array(cls[owner[keep]]), pa.array(at[keep], pa.int64()), pa.array(gram[keep], pa.int64()), pa.array(sizes[owner[keep]])], names=["cls", "pos", "gram", "size"])

    heads = packs.where("bucket < 0").withColumn("counts", F.lit(None).cast("binary"))
    found = heads.union(counted).groupBy("pack").applyInArrow(gather, "cls long, pos long, gram long, size long")
    found = stage.write(found, "heads")
    stage.drop(counted)
    return found


def centres(posts: DataFrame, similarity: Fraction) -> DataFrame:
    """(cls, pos, gram, lows) of posts(cls, pos, gram, size) whose gram several classes hold; lows: the classes that each is to meet for it.

    Bands of sizes are as wide as the similarity allows, and overlap by half: sizes that are closer have one in common, and a short
    text inside many longer ones isn't the one that they meet.
    """
    step = F.log(F.col("size").cast("double")) / F.log(F.lit(float(1 / similarity)))
    bands = F.array(F.floor(step) * 2, F.floor(step + 0.5) * 2 + 1)
    by_band = posts.withColumn("band", F.explode(bands)).groupBy("gram", "band").agg(F.min(F.struct("pos", "cls")).alias("centre"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    held = by_band.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.struct("band", F.col("centre.cls").alias("low"))).alias("centres"))
    held = held.where("low <> high").select("gram", "centres")
    lows = F.array_distinct(F.transform(F.filter("centres", lambda c: F.array_contains(bands, c["band"])), lambda c: c["low"]))
    # Equal sets of different packs have the same rows.
    return posts.join(held, "gram").select("cls", "pos", "gram", F.sort_array(lows).alias("lows")).distinct()


def classes_of(docs: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """(id, component_id) for each row of docs(id, text); component_id is the smallest id reachable over links."""
    from rankforge.llm import simhash

    stage = Stage(docs.sparkSession)
    n_buckets = 1 + (docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // BUCKET
    packs = stage.write(sketched(docs, shingle, n_buckets), "sketches")
    sketches = packs.where("bucket is null")
    # Of equal sets only the one of the smallest id goes on.
    columns = ["id", "n", "fp", *_ODD]
    classes = sketches.groupBy("cls").agg(F.min(F.struct(*columns)).alias("s")).select("cls", *(f"s.{c}" for c in columns)).withColumnRenamed("id", "low")
    classes = stage.write(classes, "classes")
    members = stage.write(sketches.select("id", "cls"), "members")
    posts = shared_prefixes(stage, packs.where("bucket is not null").select("pack", "bucket", "owners", "keys"), similarity)
    stage.drop(packs)
    near = stage.write(simhash.links(stage, classes.select("fp").distinct()), "near")
    # A fingerprint's smallest class stands for it; the others have the same fingerprint and meet that one.
    by_fp = stage.write(classes.select("fp", "cls").join(classes.groupBy("fp").agg(F.min("cls").alias("first")), "fp"), "by_fp")
    firsts = by_fp.where("cls = first").select("fp", "first")
    by_bits = near.join(firsts.withColumnsRenamed({"fp": "a", "first": "x"}), "a").join(firsts.withColumnsRenamed({"fp": "b", "first": "y"}), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    by_bits = by_bits.union(by_fp.where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")))

    met = stage.write(centres(posts, similarity), "met")
    stage.drop(posts)
    small = stage.write(classes.select("cls", "n", *_ODD), "sizes")
    t, u = similarity.numerator, similarity.denominator

    def may_be(x: str, y: str):
        """Whether sizes and parities of two sets leave room for the similarity."""
        m, n = F.col(f"{x}n"), F.col(f"{y}n")
        differ = sum((F.bit_count(F.col(x + w).bitwiseXOR(F.col(y + w))) for w in _ODD), F.lit(0))
        return (F.least(m, n) * F.lit(u) >= F.greatest(m, n) * F.lit(t)) & (differ * F.lit(u + t) <= (m + n) * F.lit(u - t))

    def possible(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b, g) that may be alike."""
        side = lambda s: small.select(*(F.col(c).alias(f"{s}_{c}") for c in small.columns))
        both = pairs.join(side("a"), F.col("a") == F.col("a_cls")).join(side("b"), F.col("b") == F.col("b_cls"))
        return both.where(may_be("a_", "b_")).select("a", "b", "g")

    stars = met.select("cls", F.explode("lows").alias("g")).where("cls <> g").select(F.least("cls", "g").alias("a"), F.greatest("cls", "g").alias("b"), "g")
    stars = stars.union(by_bits.withColumn("g", F.col("a"))).groupBy("a", "b").agg(F.min("g").alias("g"))
    stars = stage.write(possible(stars), "stars")

    def whole(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], names=["cls", "grams"])

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Texts are hashed again only for the classes of pairs, each once."""
        some = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", F.col("low").alias("id")), "cls")
        return docs.join(some, "id").select("cls", "text").dropDuplicates(["cls"]).mapInArrow(whole, "cls long, grams binary")

    sets = stage.write(sets_of(stars), "sets")
    links = verified(stage, stars, sets, similarity, "star_links")
    stage.drop(sets)
    parts = components(stage, links)
    labelled = met.drop("lows").join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    labelled = stage.write(labelled, "labelled")
    stage.drop(met)
    open_ = labelled.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("gram")
    open_ = stage.write(labelled.join(open_, "gram").join(small, "cls"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    enough = left * F.lit(u + t) >= (F.col("x.n") + F.col("y.n")) * F.lit(t)
    rest = (
        x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component")) & enough & may_be("x.", "y."))
        .groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.min("x.gram").alias("g")).join(stars, ["a", "b"], "left_anti")
    )
    rest = stage.write(rest, "rest")
    stage.drop(labelled, open_)
    sets = stage.write(sets_of(rest), "sets")
    links = links.union(verified(stage, rest, sets, similarity, "rest_links"))
    stage.drop(sets)
    parts = components(stage, links)
    rooted = classes.select("cls", "low").join(parts.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "low", F.coalesce("component", "cls").alias("root"))
    rooted = stage.write(rooted, "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    stage.drop(classes)
    return members.join(rooted.join(lows, "root").select("cls", "component_id"), "cls").select("id", "component_id")
