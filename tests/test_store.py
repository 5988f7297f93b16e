"""Written indexes: what their readers touch."""

import pytest
from pyspark.sql import functions as F

from rankforge.functions.analysis import Analyzer
from rankforge.operators import models, prf
from rankforge.operators.rank import rank
from rankforge.operators.rerank import linear_scorer
from rankforge.sources.corpus import from_documents
from rankforge.sources.index import Index

TEXTS = ["red apple pie", "red apple", "green apple tart with pie crust", "pear tart", "red pear and green pear", "blue sky"]


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    rows = [(k, t, "en", "s") for k, t in enumerate(TEXTS)]
    built = Index.build(from_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    path = str(tmp_path_factory.mktemp("store") / "ix")
    built.write(path)
    return built, Index.open(spark, path)


def test_a_written_index_answers_like_a_built_one(spark, pair):
    built, stored = pair
    queries = {"1": "#sum(red #near/2(apple pie))", "2": "tart", "3": "absent"}
    ranked = [sorted((r.qid, r.docid, r["rank"], round(r.score, 9)) for r in rank(i, queries, models.BM25(), 10).collect()) for i in pair]
    assert ranked[0] == ranked[1] and len(ranked[0]) > 4
    best = rank(built, {"1": "red"}, models.BM25(), 10)
    for algorithm in ("okapi", "rm3"):
        scores = [{r.term: round(r.score, 9) for r in prf.term_scores(i, best, prf.Feedback(algorithm, 2, 5)).collect()} for i in pair]
        assert scores[0] == scores[1] and len(scores[0]) > 2
    assert (built.doc_freq("body", "apple"), built.total_term_freq("body", "pear")) == (stored.doc_freq("body", "apple"), stored.total_term_freq("body", "pear")) == (3, 3)
    assert stored.doc_freq("body", "absent") == 0


def test_feedback_reads_its_documents_alone(spark, pair):
    best = rank(pair[1], {"1": "red"}, models.BM25(), 10)
    plan = prf.term_scores(pair[1], best, prf.Feedback("okapi", 2, 5))._jdf.queryExecution().executedPlan().toString()
    assert "/vectors" in plan and "/terms" in plan and "/postings" not in plan and "In(docid" in plan


def test_frequencies_of_terms_are_read_and_those_of_operators_counted(spark, pair):
    plan = rank(pair[1], {"1": "#sum(red apple)"}, models.BM25(), 10)._jdf.queryExecution().executedPlan().toString()
    assert "/terms" in plan and plan.count("/postings") == 1


def test_postings_are_made_without_a_shuffle_and_texts_split_once(spark, pair):
    plan = pair[0].postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def test_postings_of_odd_texts(spark, tmp_path):
    rows = [(3, "pear the pear", "en", "s"), (1, "the of", "en", "s"), (2, "", "en", "s"), (0, None, "en", "s"), (4, "the pear apple of pear the", "en", "s")]
    built = Index.build(from_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    built.write(str(tmp_path / "ix"))
    stored = Index.open(spark, str(tmp_path / "ix"))
    stored.write(str(tmp_path / "again"))
    for index in (built, stored, Index.open(spark, str(tmp_path / "again"))):
        for table in (index.postings, index.vectors or index.postings):
            got = sorted((r.term, r.docid, r.tf, r.len_all, r.positions) for r in table.collect())
            assert got == [("apple", 4, 1, 6, [2]), ("pear", 3, 2, 3, [0, 2]), ("pear", 4, 2, 6, [1, 4])]
        lengths = sorted((r.docid, r.len_all, r.len_positions, r.n_indexed) for r in index.doc_len.collect())
        assert lengths == [(0, 0, 0, 0), (1, 2, 0, 0), (2, 0, 0, 0), (3, 3, 3, 2), (4, 6, 5, 3)]
        assert sorted(map(tuple, index.term_stats().collect())) == [("body", "apple", 1, 1), ("body", "pear", 2, 4)]


def test_a_stemmer_may_be_a_python_function(spark):
    first = F.udf(lambda w: w[:3])
    index = Index.build(from_documents(spark.createDataFrame([(1, "apples the apply pear", "en", "s")], "doc_id long, text string, lang string, source string")), Analyzer(stem=(first, lambda w: w[:3])))
    assert sorted((r.term, r.positions) for r in index.postings.collect()) == [("app", [0, 2]), ("pea", [3])]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rankings_of_a_built_index_split_texts_once(spark, pair):
    plan = _plan(rank(pair[0], {"1": "#sum(red #near/2(apple pie))", "2": "tart"}, models.BM25(), 10))
    assert "regexp_extract_all" not in plan and "FileScan parquet" in plan


def test_frequencies_of_all_terms_send_no_postings(spark, pair):
    plan = _plan(pair[0].term_stats())
    assert plan.count("regexp_extract_all") == 1 and plan.count("Exchange") == 1 and "docid" not in plan.split("Exchange")[0]


def test_feedback_on_a_built_index_counts_documents_of_its_terms_without_postings(spark, pair):
    best = rank(pair[0], {"1": "red"}, models.BM25(), 10)
    plan = _plan(prf.term_scores(pair[0], best, prf.Feedback("okapi", 2, 5)))
    assert plan.count("regexp_extract_all") == 1 and "collect_list(pos" not in plan


def test_a_linear_scorer_reads_the_lengths_of_its_documents_alone(spark, pair):
    best = rank(pair[1], {"1": "red"}, models.BM25(), 10)
    scored = linear_scorer(pair[1], {"length:body": 1.0})(best)
    assert "In(docid" in _plan(scored) and {r.docid: r.score for r in scored.collect()} == {0: 3.0, 1: 2.0, 4: 5.0}
