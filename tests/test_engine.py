import random

import pytest
from pyspark.sql import functions as F

from rankforge.functions import positions
from rankforge.functions.analysis import Analyzer
from rankforge.operators import inspect, models
from rankforge.operators.rank import rank
from rankforge.plans.compile import postings_of
from rankforge.plans.parser import parse
from rankforge.plans.rewrite import optimize
from rankforge.sources.corpus import Corpus, from_frame
from rankforge.sources.index import Index

ROWS = [(0, "apple pie", "apple pie of the apple"), (1, None, "pie apple apple pie"), (2, "apple", "banana of the"), (3, None, "the of")]


@pytest.fixture(scope="module")
def index(spark):
    d = spark.createDataFrame(ROWS, "docid long, title string, body string")
    docs = d.select("docid", F.format_string("d%d", "docid").alias("ext_id"), F.create_map(F.lit("k"), F.lit("v")).alias("attrs"))
    both = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("body", "title")))
    fields = d.select("docid", F.explode(both).alias("f")).select("docid", "f.*").where("text is not null")
    return Index.build(Corpus(docs, fields))


def lists(index, query):
    found = postings_of(index, {"1": optimize(parse(query, index.analyzer))})
    return {r.docid: (r.tf, r.positions) for r in found.collect()}


def test_positions_keep_the_gaps_of_stopwords(index):
    rows = {r.docid: r.positions for r in index.posting_list("apple").collect()}
    assert rows == {0: [0, 4], 1: [1, 2]}
    assert index.doc_freq("body", "apple") == 2 and index.total_term_freq("body", "pie") == 3
    assert index.posting_list("zebra").count() == 0 and index.total_term_freq("body", "zebra") == 0


def test_three_lengths_and_statistics(index):
    rows = {r.docid: r for r in index.doc_len.where("field = 'body'").collect()}
    assert [rows[k].len_all for k in range(4)] == [5, 4, 3, 2]
    assert [rows[k].len_positions for k in range(4)] == [5, 4, 1, 0]
    assert [rows[k].n_indexed for k in range(4)] == [3, 4, 1, 0]
    assert index.sum_of_field_lengths("body") == 8 and index.doc_count("body") == 3 and index.num_docs == 4
    assert index.stats("inlink").average == 1.0 and index.field_length("body", 3) == 2 and index.field_length("url", 3) == 0


@pytest.mark.parametrize(
    "query, expected",
    [
        ("#syn(apple pie)", {0: [0, 1, 4], 1: [0, 1, 2, 3]}),
        ("#near/1(apple pie)", {0: [1], 1: [3]}),
        ("#near/2(apple pie)", {0: [1], 1: [3, 3]}),
        ("#near/1(pie apple)", {1: [1]}),
        ("#near/3(pie apple)", {0: [4], 1: [1, 2]}),
        ("#window/2(apple pie)", {0: [1], 1: [1, 3]}),
        ("#near/1(apple apple)", {1: [2]}),
        ("#window/1(apple apple)", {0: [0, 4], 1: [1, 2]}),
    ],
)
def test_position_operators(index, query, expected):
    got = lists(index, query)
    assert {k: p for k, (_, p) in got.items()} == expected
    assert all(n == len(p) for n, p in got.values())


def scores(index, query, model):
    return {r.docid: r.score for r in rank(index, {"1": query}, model, 10).collect()}


def test_boolean_models(index):
    assert scores(index, "#and(apple pie)", models.RankedBoolean()) == {0: 1.0, 1: 2.0}
    assert scores(index, "#or(apple pie banana)", models.RankedBoolean()) == {0: 2.0, 1: 2.0, 2: 1.0}
    assert scores(index, "#sum(apple pie banana)", models.UnrankedBoolean()) == {0: 2.0, 1: 2.0, 2: 1.0}
    assert scores(index, "#wsum(0.5 apple 0.25 pie)", models.UnrankedBoolean()) == {0: 0.75, 1: 0.75}
    assert scores(index, "zebra apple", models.UnrankedBoolean()) == {}


def test_bm25_by_hand(index):
    from math import log

    idf, average = log((4 - 2 + 0.5) / (2 + 0.5) + 1), 8 / 3
    got = scores(index, "apple", models.BM25())
    for docid, length in ((0, 5), (1, 4)):
        assert got[docid] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * length / average)))
    # A position operator scores by its own document frequency.
    near = scores(index, "#near/1(pie apple)", models.BM25())
    assert near[1] == pytest.approx(log(3.5 / 1.5 + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / average)))


def test_ties_by_docid_depth_and_empty_queries(index):
    rows = rank(index, {"a": "#or(apple pie)", "b": "the of"}, models.UnrankedBoolean(), 1).collect()
    assert [(r.qid, r.docid, r.ext_id, r["rank"]) for r in rows] == [("a", 0, "d0", 1)]


def test_and_within_or_and_sums_commute(index):
    m = models.BM25()
    assert set(scores(index, "#and(apple pie)", m)) <= set(scores(index, "#or(apple pie)", m))
    a, b = scores(index, "#sum(apple pie)", m), scores(index, "#sum(pie apple)", m)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_batches_equal_single_queries(index):
    qs = {"1": "#sum(apple pie)", "2": "#near/2(apple pie)", "3": "#and(#or(apple banana) pie)", "4": "apple.title"}
    batch = {(r.qid, r.docid): r.score for r in rank(index, qs, models.BM25(), 10).collect()}
    alone = {(q, r.docid): r.score for q, t in qs.items() for r in rank(index, {q: t}, models.BM25(), 10).collect()}
    assert batch == alone


def test_write_and_open(index, spark, tmp_path):
    index.write(str(tmp_path / "ix"))
    again = Index.open(spark, str(tmp_path / "ix"))
    assert scores(again, "#sum(apple pie)", models.BM25()) == scores(index, "#sum(apple pie)", models.BM25())
    assert again.fields() == ["body", "title"]
    with pytest.raises(Exception):
        Index.open(spark, str(tmp_path / "none"))


def test_scan_of_a_stored_index_is_pruned(index, spark, tmp_path):
    index.write(str(tmp_path / "ix"))
    plan = Index.open(spark, str(tmp_path / "ix")).posting_list("apple").select("docid", "tf")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "EqualTo(term,apple)" in plan
    assert "positions" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_lookups(index):
    assert index.external_id(2) == "d2" and index.internal_id("d2") == 2 and index.internal_id("x") is None
    assert index.attribute("k", 0) == "v" and index.attribute("z", 0) is None
    index.assert_unique()
    assert [r.term for r in inspect.list_terms(index, "body").collect()] == ["apple", "banana", "pie"]
    assert {r.term: r.positions for r in inspect.list_term_vector(index, 0, "body").collect()} == {"apple": [0, 4], "pie": [1]}
    with pytest.raises(ValueError):
        inspect.list_doc(index, 99)


def test_corpus_numbers_by_external_id(spark):
    t = spark.createDataFrame([("b", "x y", 1), ("a", "z", 2), ("c", None, 3)], "name string, words string, n int")
    c = from_frame(t, "name", {"body": "words"}, ["n"])
    assert {(r.docid, r.ext_id, r.attrs["n"]) for r in c.docs.collect()} == {(0, "a", "2"), (1, "b", "1"), (2, "c", "3")}
    assert Index.build(c).num_docs == 3 and Index.build(c).doc_count("body") == 2


def test_stemmed_column_equals_string(spark):
    a = Analyzer(stem="s")
    words = ["joints", "cities", "beatles", "glass", "bus", "aies", "eies", "toes", "trees", "aes", "is", "s", "ies", "es"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(a.term(F.col("w"))).collect()]
    assert got == [Analyzer(frozenset(), "s").terms_of(w)[0] for w in words]


def chains_model(ls, n):
    """All chains by brute force, depth first; a list is read up to the first position beyond reach."""
    if len(ls) == 1:
        return list(ls[0])
    out = []

    def go(k, p):
        if k == len(ls):
            out.append(p)
            return
        for q in ls[k]:
            if q - p > n:
                break
            if q > p:
                go(k + 1, q)

    for p in ls[0]:
        go(1, p)
    return out


def window_model(ls, n):
    if len(ls) == 1:
        return list(ls[0])
    at, out = [0] * len(ls), []
    while all(i < len(x) for i, x in zip(at, ls)):
        now = [x[i] for i, x in zip(at, ls)]
        if max(now) - min(now) < n:
            out.append(max(now))
            at = [i + 1 for i in at]
        else:
            at = [i + (p == min(now)) for i, p in zip(at, now)]
    return out


def test_position_expressions_against_models(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        ls = [sorted(rng.sample(range(40), rng.randint(1, 7))) for _ in range(rng.randint(1, 4))]
        if k % 4 == 0:
            ls = [[rng.choice(x) for _ in x] for x in ls]
        rows.append((k, ls, rng.randint(1, 9)))
    df = spark.createDataFrame(rows, "k int, ls array<array<int>>, n int")
    ls, n = F.col("ls"), F.col("n")
    got = df.select("k", positions.chain_ends(ls, n).alias("c"), positions.window_ends(ls, n).alias("w"), positions.chain_count(ls, n).alias("m"), positions.union(ls).alias("u")).collect()
    for r in got:
        _, own, d = rows[r.k]
        assert r.c == chains_model(own, d)
        assert r.w == window_model(own, d)
        assert r.u == sorted({p for x in own for p in x})
        if r.k % 4:
            assert r.m == len(chains_model(own, d))
