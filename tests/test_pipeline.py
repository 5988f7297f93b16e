import json

import pytest
from pyspark.sql import functions as F

from rankforge.operators import evaluate, experiments, models, prf
from rankforge.operators.rank import rank
from rankforge.operators.rerank import rerank
from rankforge.plans import pipeline
from rankforge.sources import trec
from rankforge.sources.corpus import Corpus, from_documents
from rankforge.sources.index import Index
from rankforge.sources.params import coerce
from rankforge.streaming.ingest import index_stream, open_segments

TEXTS = ["red apple pie", "red apple", "green apple tart with pie crust", "pear tart", "red pear and green pear", "blue sky"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(TEXTS)]
    return Index.build(from_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))


def test_query_files(spark, tmp_path):
    p = tmp_path / "a.qry"
    p.write_text("10:red apple\n11:a:b\n10:pear\n")
    assert trec.read_queries(spark, str(p)) == {"10": "pear", "11": "a"}
    p.write_text("10:red\n\n11:x\n")
    with pytest.raises(ValueError):
        trec.read_queries(spark, str(p))


def test_runs_go_round(spark, index, tmp_path):
    found = rank(index, {"7": "red apple", "8": "the"}, models.BM25(), 10)
    path = str(tmp_path / "run.teIn")
    trec.write_run(found, ["7", "8"], path, 2)
    lines = open(path).read().split("\n")
    assert lines[2] == "8 Q0 Nonexistent_Docid 1 0.000000000000 reference" and lines[3] == ""
    assert lines[0].split()[:2] == ["7", "Q0"] and len(lines[0].split()[4].split(".")[1]) == 12
    back = trec.read_run(spark, path).orderBy("n").collect()
    assert [(r.qid, r["rank"]) for r in back] == [("7", 1), ("7", 2), ("8", 1)]


def test_a_qid_that_comes_again_replaces_what_it_had(spark, tmp_path):
    p = tmp_path / "r"
    p.write_text("1 Q0 a 1 3.0 x\n2 Q0 b 1 2.0 x\n1 Q0 c 1 1.0 x\n1 Q0 d 2 0.5 x\n")
    assert [(r.qid, r.ext_id) for r in trec.read_run(spark, str(p)).orderBy("n").collect()] == [("2", "b"), ("1", "c"), ("1", "d")]
    assert trec.read_run(spark, str(p), max_rank=1).count() == 2
    p.write_text("1 Q0 a 1 3.0\n")
    with pytest.raises(Exception):
        trec.read_run(spark, str(p)).collect()


def test_parameters():
    assert coerce({"a": "10", "b": ["1.5", "x"], "c": {"d": 3}}) == {"a": 10, "b": [1.5, "x"], "c": {"d": 3}}
    for bad in (True, None):
        with pytest.raises(ValueError):
            coerce({"a": bad})


def test_feedback_by_hand(spark, index):
    from math import exp

    ranking = spark.createDataFrame([("1", 0, "doc-00000000", 2.0, 1), ("1", 1, "doc-00000001", 1.0, 2), ("1", 5, "doc-00000005", 0.5, 3)], "qid string, docid long, ext_id string, score double, rank int")
    got = {r.term: r.score for r in prf.term_scores(index, ranking, prf.Feedback("rm3", 2, 5)).collect()}
    w = exp(0) / (exp(0) + exp(-1))
    assert got["pie"] == pytest.approx(w / 3) and got["red"] == pytest.approx(w / 3 + (1 - w) / 2) and set(got) == {"red", "apple", "pie"}
    chosen = prf.select_terms(prf.term_scores(index, ranking, prf.Feedback("rm3", 2, 2)), 2)
    # Best last; of equal scores the smaller term is better, and listed first.
    assert [r.term for r in chosen.orderBy("place").collect()] == ["apple", "red"]
    learned = prf.learned_queries(chosen, prf.Feedback("rm3", 2, 2, field_out="title")).first().learned
    assert learned == "#wsum (0.500000 apple.title 0.500000 red.title)"
    okapi = prf.learned_queries(chosen, prf.Feedback("okapi", 2, 2)).first().learned
    assert okapi == "#sum (apple red)"


def test_expansion_rules():
    f = lambda a, w=None: prf.Feedback(a, 1, 1, orig_weight=w)
    assert prf.expand("q", None, f("okapi")) == "q"
    assert prf.expand("q", "L", f("okapi", 0.5)) == "L" and prf.expand("q", "L", f("rm3")) == "L" and prf.expand("q", "L", f("rm3", 0)) == "L"
    assert prf.expand("q", "L", f("rm3", 1)) == "q"
    assert prf.expand("q", "L", f("rm3", 0.25)) == "#wsum (0.25 #sum (q) 0.75 L)"


def test_reranking_shifts_the_tail(spark):
    rows = [("1", k, f"d{k}", 10.0 - k, k) for k in range(1, 6)]
    ranking = spark.createDataFrame(rows, "qid string, docid long, ext_id string, score double, rank int")
    flip = lambda best: best.select("qid", "docid", "ext_id", (F.col("rank") * 1.0).alias("score"))
    got = [(r.docid, round(r.score, 6)) for r in rerank(ranking, flip, 2).orderBy("rank").collect()]
    # The tail's head (7.0) comes to 0.1 below the lowest reranked score (1.0).
    assert got == [(2, 2.0), (1, 1.0), (3, 0.9), (4, -0.1), (5, -1.1)]
    high = lambda best: best.select("qid", "docid", "ext_id", (F.col("rank") + 100.0).alias("score"))
    assert [round(r.score, 6) for r in rerank(ranking, high, 2).orderBy("rank").collect()][2:] == [7.0, 6.0, 5.0]
    assert rerank(ranking, lambda best: best.limit(0).select("qid", "docid", "ext_id", "score"), 2).count() == 3


def test_measures_by_hand(spark):
    from math import log2

    run = spark.createDataFrame([("1", "a", 3.0), ("1", "b", 2.0), ("1", "c", 2.0), ("2", "x", 1.0), ("3", "y", 1.0)], "qid string, ext_id string, score double")
    qrels = spark.createDataFrame([("1", "0", "a", 0), ("1", "0", "b", 2), ("1", "0", "z", 1), ("2", "0", "q", 1)], "qid string, iter string, ext_id string, rel int")
    got = {(r.metric, r.qid): r.value for r in evaluate.measures(run, qrels).collect()}
    # Ties go by external id down: c before b.
    assert got["map", "1"] == pytest.approx((1 / 3) / 2) and got["recip_rank", "1"] == pytest.approx(1 / 3)
    assert got["P_10", "1"] == pytest.approx(0.1) and got["recall_100", "1"] == pytest.approx(0.5)
    assert got["ndcg_cut_10", "1"] == pytest.approx((2 / log2(4)) / (2 / log2(2) + 1 / log2(3)))
    assert got["num_q", "all"] == 2 and got["map", "all"] == pytest.approx(got["map", "1"] / 2) and got["num_ret", "all"] == 4
    labels = {r.label: r.value for r in evaluate.labelled(evaluate.measures(run, qrels)).collect()}
    assert labels["MRR"] == "0.1667" and len(labels) == 10


def test_win_tie_loss(spark):
    frame = lambda rows: spark.createDataFrame(rows, "qid string, map double")
    base = frame([("1", 0.5), ("2", 0.5), ("3", 0.0), ("4", 0.0), ("5", 0.5)])
    got = evaluate.win_tie_loss(base, frame([("1", 0.51), ("2", 0.505), ("3", 0.1), ("4", 0.0)]))
    assert {r.qid: r.outcome for r in got.collect()} == {"1": "WIN", "2": "TIE", "3": "WIN", "4": "TIE", "5": "LOSS"}


def test_golden_comparison_and_pivot(spark, tmp_path):
    (tmp_path / "a.teOut").write_text("map all 0.5\nP_10 all 0.1\nmap 1 0.4\n")
    (tmp_path / "b.teOut").write_text("MRR\t0.4688\n")
    a, b = trec.read_metrics(spark, str(tmp_path / "a.teOut"), "a"), trec.read_metrics(spark, str(tmp_path / "b.teOut"), "b")
    assert evaluate.missing_lines(a, a).count() == 0 and evaluate.missing_lines(a, b).count() == 2
    rows = {(r.metric, r.qid): (r.a, r.b) for r in evaluate.pivot(a.union(b), ["a", "b"]).collect()}
    assert rows["map", "all"] == ("0.5", None) and rows["MRR", "all"] == (None, "0.4688")


def test_side_caches(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "l.gz", "wt") as f:
        f.write("body,title\n2\n5,1\n7,0\n")
    with gzip.open(tmp_path / "e.gz", "wt") as f:
        f.write("head\nx-1\nx-2\n")
    assert {(r.docid, r.field, r.len_all) for r in trec.read_length_cache(spark, str(tmp_path / "l.gz")).collect()} == {(0, "body", 5), (0, "title", 1), (1, "body", 7), (1, "title", 0)}
    assert [r.ext_id for r in trec.read_id_cache(spark, str(tmp_path / "e.gz")).orderBy("docid").collect()] == ["x-1", "x-2"]


def write_case(folder, name, tasks):
    (folder / "q.qry").write_text("1:red apple\n2:the of\n")
    params = {"indexPath": "unused", "queryFilePath": str(folder / "q.qry")} | tasks
    (folder / f"{name}.param").write_text(json.dumps(params))
    return str(folder / f"{name}.param")


def test_whole_pipeline_with_feedback(spark, index, tmp_path):
    out, learned = str(tmp_path / "out.teIn"), str(tmp_path / "x.qryOut")
    path = write_case(tmp_path, "case-1", {
        "task_1:ranker": {"type": "BM25", "BM25:k_1": "1.2", "BM25:b": "0.75", "outputLength": "100"},
        "task_2:rewriter": {"type": "prf", "prf:algorithm": "rm3", "prf:numDocs": "2", "prf:numTerms": "2", "prf:rm3:origWeight": "0.5", "prf:expansionQueryFile": learned},
        "task_3:ranker": {"type": "BM25"},
        "task_4:output": {"type": "trec_eval", "outputPath": out, "outputLength": "3"},
    })
    batch = pipeline.run(spark, path, index)
    assert batch.queries["1"].startswith("#wsum (0.5 #sum (red apple) 0.5 #wsum (")
    assert batch.queries["2"] == "the of" and open(learned).read().startswith("1: #wsum (")
    rows = [line.split() for line in open(out).read().splitlines()]
    # The first output's length bounds the rankers, too.
    assert [r[0] for r in rows] == ["1", "1", "1", "2"] and rows[3][2] == "Nonexistent_Docid"
    again = write_case(tmp_path, "case-2", {"task_1:ranker": {"type": "inRankFile", "inRankFile:Path": out}, "task_2:output": {"type": "trec_eval", "outputPath": out + "2", "outputLength": 10}})
    pipeline.run(spark, again, index)
    assert [x.split()[2] for x in open(out + "2").read().splitlines()[:3]] == [r[2] for r in rows[:3]]


def test_tasks_that_are_unknown_fail(spark, index, tmp_path):
    for task in ({"task_1:agent": {}}, {"task_1:ranker": {"type": "Indri"}}, {"task_1:output": {"type": "x"}}, {"task_1:rewriter": {"type": "prf", "prf:algorithm": "rm3", "prf:numDocs": 1, "prf:numTerms": 1}}, {"task_1:ranker": {"type": "BM25"}, "task_2:reranker": {"type": "ltr"}}):
        with pytest.raises((ValueError, KeyError)):
            pipeline.run(spark, write_case(tmp_path, "bad", task), index)


def test_experiments(spark, index, tmp_path):
    for name, kind in (("exp-0", "BM25"), ("exp-1", "RankedBoolean")):
        write_case(tmp_path, name, {"task_1:ranker": {"type": kind}, "task_2:output": {"type": "trec_eval", "outputPath": str(tmp_path / f"{name}.teIn"), "outputLength": 10}})
    cases = experiments.discover(str(tmp_path), "exp-")
    runs = experiments.run_cases(spark, str(tmp_path), cases, index)
    assert cases == ["exp-0", "exp-1"] and all(str(t).endswith(" secs") for _, t in runs.values())
    qrels = spark.createDataFrame([("1", "0", "doc-00000001", 1)], "qid string, iter string, ext_id string, rel int")
    out = experiments.compare(spark, qrels, runs["exp-0"][0], {"exp-1": runs["exp-1"][0]})
    assert [r.outcome for r in out["exp-1"].collect()] in (["TIE"], ["LOSS"], ["WIN"])


def test_segments_of_a_stream_are_one_index(spark, index, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    for k in range(2):
        spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS) if i % 2 == k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    index_stream(stream, str(tmp_path / "ix"), str(tmp_path / "ck"), from_documents).awaitTermination(120)
    both = open_segments(spark, str(tmp_path / "ix"), [0, 1])
    rows = lambda ix: {(r.docid, round(r.score, 9)) for r in rank(ix, {"1": "red apple"}, models.BM25(), 10).collect()}
    assert both.num_docs == 6 and rows(both) == rows(index)


def test_entry_works_without_the_pipeline_package():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert isinstance(Corpus, type)
