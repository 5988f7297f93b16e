"""The prefix filter of near copies: counts of all documents, and sets that go to tiles."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge.llm import bpe, jaccard
from rankforge.llm.common import BATCH_KEY, Stage, release
from tests_llm_helpers import docs


def texts_of(rng, n):
    """Pieces of a few texts, between words of their own."""
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(5)]
    own = lambda k: [f"o{k}x{rng.randrange(10000)}" for _ in range(rng.randrange(30))]
    return [" ".join(rng.choice(base)[: rng.randrange(60)] + own(k) + rng.choice(base)[: rng.randrange(60)]) for k in range(n)]


@pytest.mark.parametrize("n_buckets", [1, 7])
def test_prefixes_follow_the_counts_of_all_documents(spark, monkeypatch, n_buckets):
    monkeypatch.setattr(jaccard, "PACK", 16)
    texts = [*texts_of(random.Random(n_buckets), 150), "", None]
    sets = [jaccard.shingle_set(t, 5) for t in texts]
    gram = lambda s: [int(b) << 32 | int(k) for b, k in zip(*jaccard.keys_of(s, n_buckets))]
    counts = Counter(g for s in sets for g in gram(s))
    expected = set()
    for s in sets:
        order = sorted(gram(s), key=lambda g: (counts[g], g))
        most = len(s) - -(-4 * len(s) // 5) + 1
        expected |= {(len(s), at, g) for at, g in enumerate(order[:most]) if counts[g] > 1}
    t = docs(spark, list(enumerate(texts))).repartition(3).select(F.col("doc_id").alias("id"), "text")
    stage = Stage(spark)
    packs = stage.write(jaccard.sketched(t, 5, n_buckets), "packs")
    sizes = packs.where("bucket is null").select("cls", "n").distinct()
    got = jaccard.shared_prefixes(stage, packs.where("bucket is not null").select("pack", "bucket", "owners", "keys"), Fraction(4, 5))
    assert len(expected) > 100 and {(r.n, r.pos, r.gram) for r in got.join(sizes, "cls").collect()} == expected


def test_steps_of_owners_in_one_and_in_two_bytes():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 40 if k in (0, 700) else 0, dtype=np.uint64)) for k in range(701)]
    found = [(o, b, k) for b, owners, keys in jaccard.packed(sets, 3) for o, k in zip(jaccard.unpacked(owners, len(keys) // 4), np.frombuffer(keys, np.uint32))]
    assert sorted(found) == sorted((o, b, k) for o, s in enumerate(sets) for b, k in zip(*jaccard.keys_of(s, 3)))


def test_sets_go_to_a_tile_once_whatever_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng = random.Random(5)
    sets = {k: np.unique(np.array([rng.randrange(200) for _ in range(150)], np.uint64)) for k in range(60)}
    alike = lambda a, b: 5 * len(np.intersect1d(sets[a], sets[b])) >= 2 * len(np.union1d(sets[a], sets[b]))
    pairs = [(a, b) for a in sets for b in sets if a < b]
    written = []

    class Kept(Stage):
        def write(self, df, name):
            out = super().write(df, name)
            if name == "tiled":
                tiles = out.select("g", "ta", "tb", F.explode(F.array("a", "b")).alias("cls")).distinct()
                written.append(tiles.count())
            return out

    grams = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "cls long, grams binary")
    got = jaccard.verified(Kept(spark), spark.createDataFrame([(a, b, 9) for a, b in pairs], "a long, b long, g long"), grams, Fraction(2, 5), "links")
    found = {(r.a, r.b) for r in got.collect()}
    assert found == {p for p in pairs if alike(*p)} and 100 < len(found) < len(pairs)
    # Before, two sets went to each pair.
    assert written[0] < len(pairs) / 3


def test_a_worker_gives_back_the_encoders_of_earlier_operators(spark):
    bpe._ENCODERS["key"] = object()
    release()
    assert not bpe._ENCODERS


def test_freed_memory_below_a_block_in_use_is_given_back():
    anonymous = lambda: int(open("/proc/self/smaps_rollup").read().split("Anonymous:")[1].split()[0]) / 1024
    blocks = [bytes(5000) for _ in range(30_000)]
    last = [blocks.pop(), bytes(5000)]
    del blocks
    before = anonymous()
    release()
    assert last and anonymous() < before - 100


def test_an_encoder_is_built_where_earlier_operators_left_nothing(monkeypatch):
    said = []
    monkeypatch.setattr(bpe, "release", lambda: said.append("release"))
    monkeypatch.setattr(bpe, "trim", lambda: said.append("trim"))
    monkeypatch.setattr(bpe, "Encoder", lambda vocabulary: said.append(vocabulary) or object())
    monkeypatch.setattr(bpe, "_ENCODERS", {})
    assert bpe._encoder("k", bpe.pickle.dumps("v")) is bpe._encoder("k", bpe.pickle.dumps("v"))
    assert said == ["release", "v", "trim"]


def test_batches_of_encoding_are_bounded_unless_the_caller_says(spark):
    for own in (None, "3m"):
        spark.conf.unset(BATCH_KEY)
        if own:
            spark.conf.set(BATCH_KEY, own)
        assert bpe.encode(docs(spark, [(1, "a b")])).count() == 1 and spark.conf.get(BATCH_KEY) == (own or "8m")
    spark.conf.unset(BATCH_KEY)


def test_lots_hold_few_bytes_and_every_row():
    texts = [None, "", "a" * 10, "ü" * 3, "b" * 50, None, "c", "d" * 9, *"efghij"]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    got = [x.column(1).to_pylist() for x in bpe.lots(b.slice(0), 4, 16)]
    assert sum(got, []) == texts and max(map(len, got)) == 4
    assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x) <= 16 for x in got)
    assert sum((x.column(1).to_pylist() for x in bpe.lots(b.slice(3, 5), 4, 16)), []) == texts[3:8] and not list(bpe.lots(b.slice(0, 0), 4))


def test_copies_meet_the_one_with_the_fewest_changes(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"b{k}" for k in range(400)]
    texts = [" ".join(base)]
    for k in range(150):
        words, changes = base.copy(), 4 if k < 60 else 5 + k % 4
        for at in rng.sample(range(5, 395, 5), changes):
            words[at] = f"c{k}x{at}"
        texts.append(" ".join(words))
    sets = [set(jaccard.shingle_set(t, 5).tolist()) for t in texts]
    alike = sum(5 * len(x & y) >= 4 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    written = {}

    class Kept(Stage):
        def write(self, df, name):
            out = super().write(df, name)
            written[name] = out.count()
            return out

    monkeypatch.setattr(jaccard, "Stage", Kept)
    t = docs(spark, list(enumerate(texts))).select(F.col("doc_id").alias("id"), "text")
    found = {r.id: r.component_id for r in jaccard.classes_of(t, 5, Fraction(4, 5)).collect()}
    # The unchanged text is alike to all; besides, those with four changes are alike to each other.
    assert found == dict.fromkeys(range(151), 0) and alike > 1500
    assert written["rest"] == 0 and written["stars"] <= 4 * len(texts)


def test_a_short_text_inside_longer_ones_is_not_the_one_they_meet(spark):
    posts = [(1, 0, 7, 40), (2, 3, 7, 100), (3, 1, 7, 104), (5, 9, 7, 96), (5, 9, 7, 96), (2, 4, 8, 100), (2, 4, 8, 100), (1, 2, 9, 40), (2, 2, 9, 100)]
    got = jaccard.centres(spark.createDataFrame(posts, "cls long, pos long, gram long, size long"), Fraction(4, 5))
    # A gram of one class goes; one of two that cannot be alike stays, and none of them meets the other.
    assert sorted((r.gram, r.cls, r.pos, r.lows) for r in got.collect()) == [(7, 1, 0, [1]), (7, 2, 3, [3]), (7, 3, 1, [3]), (7, 5, 9, [3, 5]), (9, 1, 2, [1]), (9, 2, 2, [2])]
