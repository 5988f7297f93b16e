"""Operators over whole tables: mixing, language models, embeddings, passages, neighbours, components, the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import ann, embedding_dedup, hmm, mixing, passages
from rankforge.llm.common import Stage, components, forest
from tests_llm_helpers import ODD, docs

VECTORS = "vec_id long, embedding array<float>, label int"


# Components.
def test_components_against_brute_force(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (60, 80), (200, 150)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 200)]
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for a, b in links:
            if a != b:
                a, b = find(a), find(b)
                top[max(a, b)] = min(a, b)
        found = components(Stage(spark), spark.createDataFrame(links, "a long, b long")).collect()
        assert {r.node: r.component for r in found} == {x: find(x) for x in top} and len(found) == len(top)
    assert components(Stage(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    a, b = np.array([1, 2, 5, 7, 7]), np.array([2, 3, 6, 0, 1])
    assert forest(9, (a, b)).tolist() == [0, 0, 0, 0, 4, 5, 5, 0, 8]


# Mixing.
def brute_targets(sizes):
    """Water filling over sources in code point order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full, out = 1.5 * sum(sizes.values()), {s for s in names if sizes[s] == 0}, {}
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2.0 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in free))
        out = {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}
        over = {s for s in free if out[s] > 2.0 * sizes[s]}
        if not over:
            return out
        full |= over


def rows_of(rng, sources, n):
    return [(k, " ".join("w" for _ in range(int(rng.lognormvariate(3, 1)))) if rng.random() > 0.02 else None, "en", rng.choice(sources)) for k in range(n)]


@pytest.mark.parametrize("chunk", [50, 8192])
def test_mix_hits_its_targets(spark, chunk):
    rng = random.Random(3)
    rows = rows_of(rng, ["a", "b", "É", "z", "zz", None, "a"], 900) + [(5000, "", "en", "empty"), (5001, "x y z", "en", "one")]
    got = mixing.decide(docs(spark, rows), chunk=chunk).collect()
    sizes = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in {r[3] for r in rows}}
    expected = brute_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(expected[s]) for r in own)
        taken = sum(r.size * r.copies for r in own)
        largest = max(r.size for r in own)
        assert abs(taken - expected[s]) <= (2 if len(own) > 20 else largest + 1), s
    assert all(0 <= r.copies <= 2 for r in got)
    again = mixing.decide(docs(spark, rows).repartition(7), chunk=chunk).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)


def test_cube_keeps_totals_and_probabilities():
    rng = random.Random(4)
    sizes = [rng.randint(1, 50) for _ in range(200)]
    n = np.zeros(200)
    for k in range(400):
        s = mixing.cube([0.3] * 200, sizes, f"s{k}", False)
        open_ = [x for x in s if 0 < x < 1]
        assert len(open_) <= 14 and sum(s) == pytest.approx(60) and sum(a * b for a, b in zip(s, sizes)) == pytest.approx(0.3 * sum(sizes))
        n += s
    assert abs(n / 400 - 0.3).max() < 0.13
    assert mixing.cube([], [], "x", True) == [] and mixing.cube([0.0, 1.0], [3, 4], "x", True) == [0.0, 1.0]


def test_mixed_rows_come_as_often_as_decided(spark):
    rng = random.Random(5)
    rows = rows_of(rng, ["a", "b"], 60) + [(7, "same", "en", "a")] * 3 + [(None, "no id", "en", "b")]
    t = docs(spark, rows).withColumn("size", F.lit("x")).withColumn("copies", F.lit(0))
    out = mixing.mix(t)
    want = Counter()
    for r in mixing.decide(t).collect():
        want[r.doc_id] += r.copies
    assert out.columns == t.columns and Counter(r.doc_id for r in out.collect()) == +want
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.decide(docs(spark, ODD)).count() == len(ODD)


# Language model.
def brute_base_scores(rows):
    words = {k: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(), b""] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    c = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    total, distinct = sum(c.values()), len(c)
    return {k: (held[k], len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws)) for k, ws in words.items()}


@pytest.mark.parametrize("symbols, head", [(1 << 14, 1 << 17), (16, 40), (16, 5)])
def test_base_scores_whatever_the_lexicon_holds(spark, symbols, head):
    rng = random.Random(6)
    rows = [(k, " ".join(f"W{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 80)))) for k in range(150)] + [(900, None), (901, "x" * 100 + " y"), (902, "x" * 100)]
    expected = brute_base_scores(rows)
    got = hmm.score(docs(spark, rows), symbols=symbols, head=head, rounds=1).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = expected[r.id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0


def brute_forward(m, line):
    alpha = m.start * m.emit[line[0]]
    for x in line[1:]:
        alpha = alpha @ m.move * m.emit[x]
    return math.log(alpha.sum())


def small_model(states=3, symbols=7, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def test_forward_equals_the_plain_recursion():
    m, rng = small_model(), np.random.default_rng(2)
    lines = [rng.integers(0, 7, n) for n in (1, 5, 2, 30, 5)]
    assert m.forward(lines) == pytest.approx([brute_forward(m, x) for x in lines])


def test_probabilities_of_all_lines_add_up():
    m = small_model(symbols=3)
    lines = [np.array([a, b, c]) for a in range(3) for b in range(3) for c in range(3)]
    assert np.exp(m.forward(lines)).sum() == pytest.approx(1)


def test_expected_counts_equal_sums_over_all_paths():
    from itertools import product

    m = small_model()
    lines = [np.array(x) for x in ([1, 4, 2, 2], [0], [6, 3])]
    start, move, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3)), 0.0
    for line in lines:
        paths = {}
        for path in product(range(3), repeat=len(line)):
            p = m.start[path[0]] * m.emit[line[0], path[0]]
            for k in range(1, len(line)):
                p *= m.move[path[k - 1], path[k]] * m.emit[line[k], path[k]]
            paths[path] = p
        z = sum(paths.values())
        total += math.log(z)
        for path, p in paths.items():
            start[path[0]] += p / z
            for k, s in enumerate(path):
                emit[line[k], s] += p / z
                if k:
                    move[path[k - 1], s] += p / z
    got = m.expect(lines)
    assert np.allclose(got.start, start) and np.allclose(got.move, move) and np.allclose(got.emit, emit) and got.log_p == pytest.approx(total)


def test_training_makes_texts_likelier(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice("abcd" if k % 2 else "wxyz") for _ in range(60))) for k in range(120)]
    coded_model = hmm.score(docs(spark, rows), rounds=6).collect()
    held = [r for r in coded_model if r.held_out]
    assert held and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_training_takes_whole_texts_and_scores_follow(spark):
    rng = random.Random(17)
    rows = [(k, " ".join(rng.choice("abcdefg" if k % 2 else "efghijk") for _ in range(rng.choice([3, 40, 2500])))) for k in range(40)]
    got = {r.id: r for r in hmm.score(docs(spark, rows), symbols=8, head=100, states=3, rounds=2).collect()}
    # The same by hand: one line after another, plain counts, words beyond the six most frequent by their share of the rest.
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    counts = Counter(w for k, t in rows if not held[k] for w in [*t.split(), ""])
    ranked = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:6]
    symbol = {w: k + 2 for k, w in enumerate(ranked)} | {"": 0}
    total, other = sum(counts.values()), [w for w in counts if w not in symbol]
    own = np.array([counts[""], sum(counts[w] for w in other), *(counts[w] for w in ranked)], float)
    unigram = (own + 1) / (total + 8)
    line = lambda t: [symbol.get(w, 1) for w in [*t.split(), ""]]
    m = hmm.Model.first(unigram, 3)
    for _ in range(2):
        start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((8, 3))
        for k, t in rows:
            if held[k]:
                continue
            x = line(t)
            alpha, beta = [m.start * m.emit[x[0]]], [np.ones(3)]
            alpha[0] /= alpha[0].sum()
            for s in x[1:]:
                a = alpha[-1] @ m.move * m.emit[s]
                alpha.append(a / a.sum())
            for s in reversed(x[1:]):
                b = m.move @ (m.emit[s] * beta[-1])
                beta.append(b / b.sum())
            beta.reverse()
            gamma = [a * b / (a * b).sum() for a, b in zip(alpha, beta)]
            start += gamma[0]
            for g, s in zip(gamma, x):
                emit[s] += g
            for a, b, s in zip(alpha, beta[1:], x[1:]):
                e = a[:, None] * m.move * (m.emit[s] * b)
                move += e / e.sum()
        m = m.update(hmm.Counts(start, move, emit, 0.0), unigram)
    rest = sum(counts[w] for w in other)
    for k, t in rows:
        inner = sum(math.log10((counts[w] + 1) / (rest + len(other) + 1)) for w in t.split() if w not in symbol)
        alpha, log_p = m.start, 0.0
        for at, x in enumerate(line(t)):
            alpha = (alpha @ m.move if at else alpha) * m.emit[x]
            log_p += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert got[k].score == pytest.approx(log_p + inner, rel=1e-6), k


def test_odd_rows_of_language_models(spark):
    got = hmm.score(docs(spark, ODD).withColumn("score", F.lit(1)).withColumn("ids", F.lit(2)), rounds=1).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got)
    assert hmm.score(docs(spark, []), rounds=1).count() == 0
    alone = hmm.score(docs(spark, [(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2]), rounds=1).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in alone)


# Embeddings.
def vector_rows(rng, n, dim=16):
    rows = []
    for k in range(n):
        base = rng.standard_normal(dim)
        rows.append(base)
        if k % 5 == 0:
            rows += [base + rng.standard_normal(dim) * s for s in (0.05, 0.1, 0.2, 0.25)]
        if k % 40 == 0:
            rows += [base] * 4 + [base * 2.5]
    rows = [r.astype(np.float32) for r in rows]
    return [(k, [float(x) for x in r], 0) for k, r in enumerate(rows)]


BAD = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [1.0, None] + [0.0] * 14, 0), (9004, [float("nan")] + [1.0] * 15, 0), (9005, [float("inf")] + [1.0] * 15, 0), (9006, [], 0), (9007, [1.0, 2.0], 0), (9008, [2.0, 4.0], 0)]


def brute_links(rows):
    ok = [(k, np.array(v, np.float64)) for k, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, top = Counter(), {k: k for k, *_ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(ok):
        for b, y in ok[:i]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x * (y @ y)) >= 0.95:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {k: (n[k], find(k)) for k in top}


@pytest.mark.parametrize("tile", [20, 1024])
def test_embedding_links_against_brute_force(spark, tile):
    rows = vector_rows(np.random.default_rng(1), 250) + BAD
    expected = brute_links(rows)
    t = spark.createDataFrame(rows, VECTORS).withColumn("cid", F.lit(1)).withColumn("n_links", F.lit(1)).repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(t, tile=tile).collect()}
    assert got == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in embedding_dedup.dedup(t, tile=tile).collect())


def test_embeddings_in_double_and_few_dimensions(spark):
    rng = np.random.default_rng(2)
    for dim in (1, 2, 3, 5):
        rows = [(k, [float(x) for x in rng.standard_normal(dim)], 0) for k in range(60)]
        t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(t).collect()} == brute_links(rows)


def test_no_embeddings(spark):
    assert embedding_dedup.dedup(spark.createDataFrame([], VECTORS)).count() == 0
    nulls = embedding_dedup.dedup(spark.createDataFrame([(None, [1.0] * 4, 0), (3, [1.0] * 4, 0), (None, None, 0)], VECTORS)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in nulls) == [(-1, 0, True), (-1, 1, True), (3, 1, True)]


# Neighbours.
def brute_nearest(rows, k=10):
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, x in ok:
        if a % 100 == 0:
            d = sorted((math.sqrt(((x - y) ** 2).sum()), b) for b, y in ok if b != a and len(x) == len(y))
            out[a] = d[:k]
    return out


def test_neighbours_recall_and_exact_scores(spark):
    rows = vector_rows(np.random.default_rng(3), 2500) + [(20000 + k, rows_copy, 0) for k, rows_copy in enumerate([[0.5] * 16] * 300)] + BAD
    t = spark.createDataFrame(rows, VECTORS).repartition(6)
    clean = ann.prepared(t)
    stage = Stage(spark)
    queries = clean.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = ann.search(stage, ann.index(stage, clean, shard=700), queries).collect()
    expected, hits = brute_nearest(rows), 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(by) == set(expected)
    vectors = {i: np.array(v, np.float64) for i, v, _ in rows if v and None not in v}
    for q, got in by.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, len(expected[q]) + 1)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        assert all(s == pytest.approx(math.sqrt(((vectors[q] - vectors[v]) ** 2).sum()), abs=1e-12) for _, s, v in got)
        hits += len({g[2] for g in got} & {b for _, b in expected[q]})
    assert hits / sum(map(len, expected.values())) >= 0.9
    # Among copies the smallest ids come first, the query itself left out.
    assert [v for *_, v in by[20000]] == list(range(20001, 20011)) and [v for *_, v in by[20100]] == list(range(20000, 20010))


def test_few_and_no_vectors(spark):
    rows = [(100, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (None, [1.0, 1.0], 0), (200, None, 0), (300, [1.0, 2.0, 3.0], 0)]
    t = spark.createDataFrame(rows, VECTORS)
    stage, clean = Stage(spark), ann.prepared(t)
    queries = clean.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(stage, ann.index(stage, clean), queries).collect()] == [(100, 1, 5)]
    none = ann.prepared(spark.createDataFrame([], VECTORS))
    assert ann.search(stage, ann.index(stage, none), none.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_every_node_can_be_reached():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((300, 8)) * 1e-4 + c for c in rng.standard_normal((6, 8)) * 10])
    g = ann.Graph(x)
    nodes, out = g.layers()[0]
    assert nodes.tolist() == list(range(len(x))) or len(g.layers()) == 1
    out = out[np.argsort(nodes)]
    seen, front = {g.entry}, [g.entry]
    while front:
        front = [j for i in front for j in out[i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == len(x) == len(nodes)


def test_neighbours_of_repeated_rows_copies_and_several_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    same, far = [1.0] * 8, [40.0] + [0.0] * 7
    rows = [(0, same, 0)] * 12 + [(7, same, 0), (1000, same, 0), (1000, same, 0)]
    rows += [(k, [float(v) for v in rng.standard_normal(8) * 3], 0) for k in range(100, 140)]
    rows += [(k, far, 0) for k in range(500, 530)] * 2  # ties, and repeated rows
    rows += [(60, [float(v) for v in rng.standard_normal(8)], 0), (60, same, 0)]  # one id with two vectors
    rows += [(200, [0.0] * 8, 0), (None, same, 0), (300, None, 0), (400, [math.nan] * 8, 0)]
    t = spark.createDataFrame(rows, VECTORS)
    t.withColumn("rank", F.lit(3)).withColumn("dim", F.lit(1)).withColumn("score", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in ann.op10_ann(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    by = {}
    for i, v, _ in rows:
        if i is not None and v and any(v) and all(map(math.isfinite, v)):
            by.setdefault(i, set()).add(tuple(v))
    for q in [i for i in by if i % 100 == 0]:
        near = sorted((min(math.dist(a, b) for a in by[q] for b in by[i]), i) for i in by if i != q)[:10]
        assert [(k, i) for k, i, _ in sorted(got.pop(q))] == [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert not got


# Passages.
def test_planted_passages_are_found_and_nothing_else(spark):
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage, other = words(60), words(80)
    texts = [words(rng.randint(100, 400)) for _ in range(60)]
    where = {}
    for k, p in ((3, passage), (17, passage), (40, passage), (8, other), (9, other)):
        at = rng.randrange(len(texts[k]))
        texts[k][at:at] = p
        where[k] = (at, at + len(p))
    fuzzy = list(other)
    for k in (10, 30, 31, 55):
        fuzzy[k] = "edited"
    del fuzzy[40]
    texts[20][50:50] = fuzzy
    where[20] = (50, 50 + len(fuzzy))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(100, None), (101, ""), (102, "short text"), (103, " ".join(texts[1])), (104, " ".join(texts[1]).upper())]
    rows += [(200 + k, " ".join(words(100) + passage)) for k in range(40)]
    found = passages.passages(docs(spark, rows).withColumn("words", F.lit(1)).repartition(3)).collect()
    spans = {}
    for r in found:
        assert r.end - r.start >= 50 and r.similarity >= 0.8 and r.doc_id != r.other_id
        spans.setdefault(r.doc_id, set()).add((r.start, r.end))
        spans.setdefault(r.other_id, set()).add((r.other_start, r.other_end))
    assert set(spans) == set(where) | {1, 103, 104} | set(range(200, 240))
    for k, (a, b) in where.items():
        assert any(s <= a + 3 and b - 3 <= e and e - s <= b - a + 6 for s, e in spans[k]), (k, spans[k], (a, b))
    assert len(found) <= 2 * len(rows)


def test_a_passage_that_stands_twice_in_the_first_document(spark):
    rng = random.Random(13)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage = words(60)
    rows = [(0, " ".join(words(20) + passage + words(30) + passage + words(20))), (1, " ".join(words(25) + passage + words(5)))]
    found = passages.passages(docs(spark, rows).coalesce(1)).collect()
    spans = {(r.start, r.end) if r.doc_id == 0 else (r.other_start, r.other_end) for r in found}
    for a, b in ((20, 80), (110, 170)):
        assert any(s <= a + 3 and b - 3 <= e <= b + 6 for s, e in spans), spans


def test_adjacent_frequent_lines_are_one_passage(spark):
    rng = random.Random(14)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    early, middle, late, want = [], [], [], []
    for k in range(8):
        x, y = words(30), words(30)
        early += [words(30) + x + words(20), words(30) + y + words(20)]
        late += [words(30) + x + words(20), words(30) + y + words(20)]
        want.append((len(middle), len(middle) + 1))
        middle += [words(40) + x + y + words(40), words(25) + x + y + words(30)]
    rows = [(k, " ".join(t)) for k, t in enumerate(early + middle + late)]
    found = {tuple(sorted((r.doc_id, r.other_id))) for r in passages.passages(docs(spark, rows).coalesce(1)).collect()}
    assert {(len(early) + a, len(early) + b) for a, b in want} <= found


def test_a_passage_whose_pieces_stand_elsewhere_too(spark):
    rng = random.Random(15)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage = words(70)
    pieces = [" ".join(words(30) + passage[k : k + 5 + k % 3] + words(30)) for k in [*range(66)] * 2]
    both = [" ".join(words(20) + passage + words(15)), " ".join(words(35) + passage + words(10))]
    rows = list(enumerate(pieces[:66] + both + pieces[66:]))
    (r,) = passages.passages(docs(spark, rows).coalesce(1)).collect()
    assert {r.doc_id, r.other_id} == {66, 67} and r.end - r.start >= 70


def test_a_fuzzy_passage_whose_seeds_stand_elsewhere_too(spark):
    rng = random.Random(17)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    rows, want = [], []
    for x in range(6):
        passage = words(90)
        fuzzy = [f"e{x}" if k in (30, 61) else w for k, w in enumerate(passage)]
        pieces = [" ".join(words(30) + passage[k : k + 5] + words(30)) for k in range(86)]
        both = [" ".join(words(20) + passage + words(15)), " ".join(words(35) + fuzzy + words(10))]
        want.append((len(rows) + 86, len(rows) + 87))
        rows += pieces + both + [" ".join(words(30) + passage[k : k + 5] + words(30)) for k in range(86)]
    found = passages.passages(docs(spark, list(enumerate(rows))).coalesce(1)).collect()
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in found} == set(want)
    assert all(r.similarity >= 0.9 for r in found)


def test_texts_that_repeat_themselves(spark):
    rows = [(0, "on at " * 300), (1, "on at " * 1000), (2, "x y z " + "on at " * 500), (3, "la " * 5000), (4, "la " * 20000)]
    found = passages.passages(docs(spark, rows).coalesce(1)).collect()
    assert len(found) < 60
    words, there = {k: len(t.split()) for k, t in rows}, {}
    for r in found:
        there.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        there.setdefault(r.other_id, set()).update(range(r.other_start, r.other_end))
    assert all(len(there[k]) >= n - 6 for k, n in words.items())


def test_all_verbatim_runs_against_brute_force(spark):
    rng = random.Random(16)
    lines = [[f"v{rng.randrange(4000)}" for _ in range(rng.randint(12, 40))] for _ in range(14)]
    texts = [[w for _ in range(rng.randint(2, 6)) for w in (rng.choice(lines) if rng.random() < 0.8 else [f"u{rng.randrange(10**6)}" for _ in range(8)])] for _ in range(50)]
    texts += [texts[3], texts[3], texts[7] + texts[3]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(None, " ".join(texts[3])), (5, None), (6, "")]
    found = [r for r in passages.passages(docs(spark, rows).withColumn("row", F.lit(1)).withColumn("salt", F.lit(1)).repartition(3)).collect() if None not in (r.doc_id, r.other_id)]
    size, where = passages.LEAST_WORDS + passages.THIN - 1, {}
    for k, t in enumerate(texts):
        for at in range(len(t) - size + 1):
            where.setdefault(tuple(t[at : at + size]), set()).add((k, at))
    spans, top = {}, list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in found:
        assert texts[r.doc_id][r.start : r.end] and r.similarity >= 0.8
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
        spans.setdefault(r.other_id, []).append((r.other_start, r.other_end))
        top[find(r.doc_id)] = find(r.other_id)
    checked = 0
    for held in where.values():
        if len({k for k, _ in held}) > 1:
            assert len({find(k) for k, _ in held}) == 1
            for k, at in held:
                checked += 1
                assert any(min(e, at + size) - max(s, at) >= passages.LEAST_WORDS for s, e in spans[k]), (k, at)
    assert checked > 150


def test_chains_against_brute_force():
    from itertools import combinations

    rng = random.Random(9)
    for _ in range(150):
        segs = np.array([(rng.randrange(30), rng.randrange(30), rng.randint(1, 6)) for _ in range(rng.randint(1, 8))])
        best = 0.0
        for n in range(1, len(segs) + 1):
            for combo in combinations(sorted(map(tuple, segs.tolist())), n):
                score, ok = combo[0][2], True
                for x, y in zip(combo, combo[1:]):
                    dp, dq = y[0] - x[0] - x[2], y[1] - x[1] - x[2]
                    ok &= dp >= 0 and dq >= 0
                    score += y[2] - 0.5 * (dp + dq)
                if ok:
                    best = max(best, score)
        first = passages.chains(segs, 0.5)[0]
        got = first[0][2] + sum(y[2] - 0.5 * ((y[0] - x[0] - x[2]) + (y[1] - x[1] - x[2])) for x, y in zip(first, first[1:]))
        assert got == pytest.approx(best)


def test_word_hashes_tell_words_apart_wherever_they_stand():
    rng = random.Random(19)
    seen: dict[bytes, int] = {}
    for n in (0, 1, 3, 400, 60_000):
        words = ["".join(rng.choice("abAB\u00e9\U0001f44d1") for _ in range(rng.choice([1, 2, 3, 9, 40]))) for _ in range(n)]
        text = "".join(rng.choice(" \t\n\r\x0b\x0c") * rng.randint(1, 3) + w for w in words) + " "
        hashes = passages.word_hashes(text).tolist()
        plain = text.encode().lower().split()
        assert len(hashes) == len(plain)
        for w, h in zip(plain, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 10_000 and len(passages.word_hashes(None)) == 0


def test_seeds_are_the_smallest_of_windows():
    rng = np.random.default_rng(12)
    for n in range(1, 40):
        for window in (1, 2, 4, 12):
            keys = rng.integers(0, 8 if n % 2 else 1 << 40, n).astype(np.uint64)
            w = min(window, n)
            views = [range(k, k + w) for k in range(n - w + 1)]
            expected = {i for v in views for i in v if keys[i] == min(keys[j] for j in v)}
            assert set(np.flatnonzero(passages.lowest(keys, window)).tolist()) == expected
            assert passages.extremes(keys, window).tolist() == [min(keys[j] for j in v) for v in views]


def test_common_subsequence():
    rng = random.Random(10)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert passages.common(np.array(a, int), np.array(b, int)) == t[-1][-1]


def test_no_passages(spark):
    assert passages.passages(docs(spark, [])).count() == 0
    assert passages.passages(docs(spark, ODD)).count() == 0


# Pipeline.
def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(11)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(k, say("aeioulmn" if k % 2 else "xyzkqwj", 80), "aa" if k % 2 else "bb", f"s{k % 3}") for k in range(90)]
    rows += [(100, rows[1][1], "aa", "s0"), (101, "12 34 !!", "aa", "s0"), (102, None, "bb", "s1"), (103, rows[2][1] + " token = abcdefghijk1", "bb", "s1")]
    table = docs(spark, rows)
    table.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    held, sizes = table, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path / "sf"))
        if k < 4:
            assert out.columns == table.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        held = spark.read.parquet(str(tmp_path / f"{k}"))
        sizes.append({r.doc_id for r in held.select("doc_id").collect()})
    assert {101, 102}.isdisjoint(sizes[0]) and len(sizes[0]) == 92
    assert 100 not in sizes[1] and len(sizes[1]) in (90, 91) and sizes[2] == sizes[1]
    redacted = [r.text for r in spark.read.parquet(str(tmp_path / "2")).collect() if r.text.endswith("<secret>")]
    assert len(redacted) == (103 in sizes[1])
    mixed = spark.read.parquet(str(tmp_path / "3"))
    assert held.count() == mixed.count() and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    whole = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, held.collect()))


def test_runs_and_ends_of_passages_cost_no_step_too_many(monkeypatch):
    rng = np.random.default_rng(3)
    h, mixed, calls = rng.integers(0, 1 << 63, 300, dtype=np.uint64), passages._mixed, []
    monkeypatch.setattr(passages, "_mixed", lambda a, b: calls.append(len(a)) or mixed(a, b))
    five = passages.runs(h, 5)
    # Runs of 2 and of 4, and two parts put together; before, runs of 8, too.
    assert len(calls) == 4
    assert all((passages.runs(h[k : k + 5], 5) == five[k]).all() for k in range(296))
    shared = np.arange(0, 290, 3)
    for f in (passages.neighbours, passages.shared_runs):
        for x, y in zip(f(h, shared, 50), f(h, shared, 50, five)):
            assert (x == y).all()
    for alike in (0, 3, 7, 8, 9, 71, 72, 73, 200):
        a = np.arange(200)
        b = np.where(a < alike, a, -1)
        assert passages.extend(a, b) == (alike, alike)
        # One word that differs, and more that are alike after it.
        b[alike // 2] = -2
        rest = alike - alike // 2 - 1
        assert passages.extend(a, b) == ((alike, alike - 1) if rest > 2 else (alike // 2, alike // 2))


def test_texts_hashed_together_have_the_places_they_have_alone(monkeypatch):
    rng = random.Random(21)
    words = lambda n: " ".join(rng.choice(["la", f"v{rng.randrange(40)}", f"é{rng.randrange(10**9)}"]) for _ in range(n))
    texts = [words(rng.choice([0, 1, 4, 5, 15, 16, 17, 49, 50, 51, 52, 53, 54, 70, 300])) for _ in range(120)] + ["", " \x0b\x0c ", "a" * 5000]
    alone = [passages.word_hashes(t) for t in texts]
    mixed, calls = passages._mixed, []
    monkeypatch.setattr(passages, "_mixed", lambda a, b: calls.append(len(a)) or mixed(a, b))
    for most in (0, 2000, passages.LOT):
        calls.clear()
        lots = list(passages.hashed([t.encode() for t in texts], most))
        # Before, texts were hashed one by one.
        assert len(calls) == len(lots) and (most != 0 or len(lots) == len(texts)) and (most != passages.LOT or len(lots) == 1)
        done = 0
        for first, h, bounds in lots:
            assert first == done and bounds[0] == 0 and bounds[-1] == len(h)
            done += len(bounds) - 1
            sides = list(zip(alone[first:done], bounds.tolist(), bounds[1:].tolist()))
            assert all((h[i:j] == x).all() and len(x) == j - i for x, i, j in sides)
            want = [(i + p, key) for x, i, _ in sides for p, key in zip(*(v.tolist() for v in passages.seeds(x)))]
            assert list(zip(*(v.tolist() for v in passages.seeds(h, bounds)))) == want
            for share in (0.8, 1.0):
                shared = [np.array([p for p in passages.seeds(x)[0].tolist() if rng.random() < share], int) for x, _, _ in sides]
                all_shared = np.concatenate([p + i for p, (_, i, _) in zip(shared, sides)])
                for f, shift in ((passages.neighbours, (1 << 32) + 1), (passages.shared_runs, 1)):
                    want = [(p + i * shift, key) for s, (x, i, _) in zip(shared, sides) if len(x) >= 50 for p, key in zip(*(v.tolist() for v in f(x, s, 50)))]
                    got = zip(*(v.tolist() for v in f(h, all_shared, 50, None, bounds)))
                    long = {k for _, i, j in sides if j - i >= 50 for k in range(i, j)}
                    assert [(p, key) for p, key in got if (p >> 32 if shift > 1 else p) in long] == want
        assert done == len(texts)


def test_segments_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(22)
    of = np.sort(rng.integers(0, 30, 600))
    p, q, n = rng.integers(0, 60, 600), rng.integers(0, 60, 600) // 9 * 9, rng.choice([5, 50], 600)
    found, number = passages.segments(of, p, q, n)
    for k in range(30):
        one, _ = passages.segments(of[of == k], p[of == k], q[of == k], n[of == k])
        assert (found[number == k] == one).all()
    assert len(number) == len(found) > 100


def test_first_and_last_documents_of_passages_are_found_without_sorting(spark, monkeypatch):
    rng = random.Random(23)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage, plans, write = words(60), {}, Stage.write

    def seen(self, df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(Stage, "write", seen)
    rows = [(k, " ".join(words(40) + passage + words(30) + passage * (k == 1))) for k in range(4)]
    found = passages.passages(docs(spark, rows).repartition(2)).collect()
    assert {r.doc_id for r in found} | {r.other_id for r in found} == {0, 1, 2, 3}
    assert len(plans["shared"]) == len(plans["met"]) == 2
    # Before: a SortAggregate for each kind of key, and a join that sorted all places.
    assert all("HashAggregate" in p and "Sort" not in p for p in plans["shared"])
    assert all("ShuffledHashJoin" in p and "Sort" not in p for p in plans["met"])


def test_a_first_text_goes_only_to_as_many_salts_as_it_needs(spark, monkeypatch):
    rng = random.Random(24)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage, dealt, write = words(60), [], Stage.write

    def seen(self, df, name):
        out = write(self, df, name)
        if "salt" in df.columns:
            dealt.extend(out.select("a", "b", "salt").collect())
        return out

    monkeypatch.setattr(Stage, "write", seen)
    found = passages.passages(docs(spark, [(k, " ".join(words(40) + passage + words(30))) for k in range(41)]).coalesce(1)).collect()
    assert {r.doc_id for r in found} | {r.other_id for r in found} == set(range(41))
    met = Counter(r.a for r in dealt)
    assert max(met.values()) == 40
    # Before, by one of 256 numbers for each document met.
    assert all(len({r.salt for r in dealt if r.a == a}) <= math.ceil(n / 8) for a, n in met.items())
