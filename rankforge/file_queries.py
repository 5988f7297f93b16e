"""Queries of what the engine reads, writes and rejects: files, parameters, the query language, pipelines, experiments."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from rankforge import oracle
from rankforge.operators import evaluate, experiments, models, prf
from rankforge.operators.rank import rank
from rankforge.operators.rerank import linear_scorer
from rankforge.plans import pipeline
from rankforge.plans.parser import parse
from rankforge.plans.rewrite import optimize, prepare
from rankforge.plans.tree import Node, QuerySyntaxError
from rankforge.queries import _DOCS, _EVAL, _TERMS, BATCH, PRF_QUERY, _judgements, _prf_sql, _query, documents
from rankforge.sources import trec
from rankforge.sources.corpus import scratch, write_text
from rankforge.sources.params import coerce


def _values(columns: str, rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({columns})"


def _file(spark, *lines: str) -> str:
    path = f"{scratch(spark)}/lines.txt"
    write_text(spark, path, lines)
    return path


# Files.
@_query("query_file", _values("qid, query", [("10", "pear"), ("11", "a"), ("12", "#and(x y)")]))
def query_file(spark, sf_dir):
    """Of equal qids the last line counts; what stands after a second colon is lost."""
    found = trec.read_queries(spark, _file(spark, "10:red apple", "11:a:b", "12: #and(x y) ", "10:pear"))
    return spark.createDataFrame(list(found.items()), "qid string, query string")


@_query("run_file", _values("qid, ext_id, score, rank", [("2", "b", 2.0, 1), ("1", "c", 1.0, 1), ("1", "d", 0.5, 2)]).replace("SELECT *", "SELECT qid, ext_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank"))
def run_file(spark, sf_dir):
    """A qid that comes again replaces what it had."""
    return trec.read_run(spark, _file(spark, "1 Q0 a 1 3.0 x", "2 Q0 b 1 2.0 x", "1 Q0 c 1 1.0 x", "1  Q0 d\t2 0.5 x")).drop("n")


@_query("run_as_ranking", oracle.ranking(_EVAL, after="SELECT qid, docid, ext_id, score, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT '5', NULL, 'Nonexistent_Docid', 0.0, 1"))
def run_as_ranking(spark, sf_dir):
    """A ranker that reads a run: documents by name, in the order of the file."""
    index, path = documents(spark, sf_dir), f"{scratch(spark)}/run.inRank"
    trec.write_run(rank(index, BATCH, models.BM25(), 20, digits=6), list(BATCH), path, 20)
    return pipeline.read_ranking(index, BATCH, path)


@_query("qrels_file", "SELECT '1' AS qid, '0' AS iter, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS ext_id, CAST(quality AS INTEGER) AS rel FROM labels")
def qrels_file(spark, sf_dir):
    path = f"{scratch(spark)}/qrels"
    _judgements(spark, sf_dir, ["1"]).select(F.concat_ws(" ", "qid", "iter", "ext_id", "rel").alias("value")).write.text(path)
    return trec.read_qrels(spark, path)


@_query("expansion_file", _prf_sql("okapi", "SELECT qid || ': #sum (' || string_agg(term, ' ' ORDER BY score, term) || ')' AS line FROM sel GROUP BY qid"))
def expansion_file(spark, sf_dir):
    index, path = documents(spark, sf_dir), f"{scratch(spark)}/queries.qryOut"
    best = rank(index, PRF_QUERY, models.BM25(), 100, digits=6)
    learned, _ = prf.rewrite(index, PRF_QUERY, best, prf.Feedback("okapi", _DOCS, _TERMS))
    trec.write_expansion(spark, learned, path)
    return trec.numbered_lines(spark, path).select("line")


@_query("metric_file", _values("run, metric, qid, value", [("a", "map", "1", "0.25"), ("a", "map", "all", "0.5"), ("a", "MRR", "all", "1.0")]))
def metric_file(spark, sf_dir):
    """Lines of three columns, and of two, which are over all queries."""
    return trec.read_metrics(spark, _file(spark, "map\t1\t0.25", "map all 0.5", "", "MRR 1.0"), "a")


def _zipped(spark, *lines: str) -> str:
    path = f"{scratch(spark)}/cache.gz"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs_path)
    out.write(bytearray(gzip.compress("".join(f"{x}\n" for x in lines).encode())))
    out.close()
    return path


@_query("length_cache", "SELECT * FROM (VALUES (0::BIGINT, 'body', 3::INTEGER), (0, 'title', 1), (1, 'body', 0), (1, 'title', 2)) t(docid, field, len_all)")
def length_cache(spark, sf_dir):
    return trec.read_length_cache(spark, _zipped(spark, "body,title", "2", "3,1", "0,2"))


@_query("id_cache", "SELECT * FROM (VALUES (0::BIGINT, 'a-1'), (1, 'b-2'), (2, 'c 3')) t(docid, ext_id)")
def id_cache(spark, sf_dir):
    return trec.read_id_cache(spark, _zipped(spark, "header", "a-1", "b-2", "c 3"))


_PARAMETERS = {"depth": "100", "b": "0.75", "name": "BM25", "list": ["1", "x", "-2.5"], "task_1:ranker": {"k": "7", "flag": 3}}


@_query("parameters", _values("key, kind, value", [("depth", "int", "100"), ("b", "float", "0.75"), ("name", "str", "BM25"), ("list.0", "int", "1"), ("list.1", "str", "x"), ("list.2", "float", "-2.5"), ("task_1:ranker.k", "int", "7"), ("task_1:ranker.flag", "int", "3"), ("true", "error", ""), ("null", "error", "")]))
def parameters(spark, sf_dir):
    rows = []

    def walk(key: str, value) -> None:
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if items is None:
            rows.append((key, type(value).__name__, str(value)))
        else:
            for k, v in items:
                walk(f"{key}.{k}" if key else str(k), v)

    walk("", coerce(_PARAMETERS))
    for name, value in (("true", True), ("null", None)):
        try:
            walk(name, coerce({name: value}))
        except ValueError:
            rows.append((name, "error", ""))
    return spark.createDataFrame(rows, "key string, kind string, value string")


# The query language: each query with its tree as it is written, and as it is run; hand-made on the other side.
_LANGUAGE = [
    ("red Apple", "#AND(#SCORE(red.body ) #SCORE(apple.body ) )", "#AND(#SCORE(red.body ) #SCORE(apple.body ) )"),
    ("#Near/3(red apple.title)", None, None),
    ("#near/3(red apple)", "#AND(#SCORE(#NEAR/3(red.body apple.body ) ) )", "#SCORE(#NEAR/3(red.body apple.body ) )"),
    ("#window/0(a b)", None, None), ("#near(red apple)", None, None), ("#nand(red apple)", None, None), ("red)", None, None), ("(red", None, None), ("red) (apple", None, None),
    ("the of", "#AND()", None),
    ("#or(the red) #syn(of)", "#AND(#OR(#SCORE(red.body ) ) #SCORE(#SYN() ) )", "#SCORE(red.body )"),
    ("#sum(red red apple)", "#AND(#SUM(#SCORE(red.body ) #SCORE(red.body ) #SCORE(apple.body ) ) )", "#WSUM(#SCORE(red.body ) #SCORE(apple.body ) )"),
    ("#sum(red red)", "#AND(#SUM(#SCORE(red.body ) #SCORE(red.body ) ) )", "#SCORE(red.body )"),
    ("#wsum(0.5 red 0.5 the 2 apple.url)", "#AND(#WSUM(#SCORE(red.body ) #SCORE(apple.url ) ) )", "#WSUM(#SCORE(red.body ) #SCORE(apple.url ) )"),
    ("#wsum(red apple)", None, None), ("#wsum(0.5)", None, None), ("3.5", None, None), ("red.nofield", None, None), ("#syn(#and(red apple))", None, None), ("red-apple", "#AND(#SCORE(red.body ) #SCORE(apple.body ) )", "#AND(#SCORE(red.body ) #SCORE(apple.body ) )"),
    ("#syn(red the #near/2(pie apple))", "#AND(#SCORE(#SYN(red.body #NEAR/2(pie.body apple.body ) ) ) )", "#SCORE(#SYN(red.body #NEAR/2(pie.body apple.body ) ) )"),
]


@_query("query_trees", _values("query, tree, run", _LANGUAGE))
def query_trees(spark, sf_dir):
    """Trees as text, null for a syntax error (and for a query of which nothing is left to run)."""
    analyzer, rows = documents(spark, sf_dir).analyzer, []
    for query, _, _ in _LANGUAGE:
        try:
            tree = parse(query, analyzer, "#AND")
            best = prepare(optimize(tree))
            rows.append((query, str(tree), None if best is None else str(best)))
        except QuerySyntaxError:
            rows.append((query, None, None))
    return spark.createDataFrame(rows, "query string, tree string, run string")


_T = lambda term, field="body": Node("TERM", term=term, field=field)
_CHECKS = [
    ("term in term", "error"), ("score of score", "error"), ("score of two", "error"), ("syn of two fields", "error"), ("near of and", "error"), ("syn of one field", "#SYN(a.body b.body )"), ("and of term", "#AND(#SCORE(a.body ) )"),
]


@_query("tree_checks", _values("name, outcome", _CHECKS))
def tree_checks(spark, sf_dir):
    """What operators take."""
    cases = [
        (_T("a"), [_T("b")]), (Node("SCORE"), [Node("SCORE", [_T("a")])]), (Node("SCORE"), [_T("a"), _T("b")]), (Node("SYN"), [_T("a"), _T("b", "title")]),
        (Node("NEAR", n=2), [Node("AND")]), (Node("SYN"), [_T("a"), _T("b")]), (Node("AND"), [_T("a")]),
    ]
    rows = []
    for (name, _), (node, args) in zip(_CHECKS, cases):
        try:
            for a in args:
                node.add(a)
            rows.append((name, str(node)))
        except QuerySyntaxError:
            rows.append((name, "error"))
    return spark.createDataFrame(rows, "name string, outcome string")


_EXPANDED = [("okapi", None, "L"), ("okapi", 0.5, "L"), ("rm3", None, "L"), ("rm3", 0.0, "L"), ("rm3", 1.0, "q"), ("rm3", 0.25, "#wsum (0.25 #sum (q) 0.75 L)"), ("nothing learned", None, "q")]


@_query("prf_expanded", _values("algorithm, weight, expanded", _EXPANDED).replace("SELECT *", "SELECT algorithm, CAST(weight AS DOUBLE) AS weight, expanded"))
def prf_expanded(spark, sf_dir):
    """What runs after feedback."""
    rows = [(a, w, prf.expand("q", None if a == "nothing learned" else "L", prf.Feedback("okapi" if a == "nothing learned" else a, 1, 1, orig_weight=w))) for a, w, _ in _EXPANDED]
    return spark.createDataFrame(rows, "algorithm string, weight double, expanded string")


@_query("unique_ids", _values("name, outcome", [("documents", "unique"), ("sources", "error")]))
def unique_ids(spark, sf_dir):
    index, rows = documents(spark, sf_dir), []
    for name, docs in (("documents", index.docs), ("sources", index.docs.withColumn("ext_id", F.col("attrs")["lang"]))):
        index.docs = docs
        try:
            index.assert_unique()
            rows.append((name, "unique"))
        except ValueError:
            rows.append((name, "error"))
    return spark.createDataFrame(rows, "name string, outcome string")


# Pipelines: parameters, tasks in order, one run file out.
def _case(spark, path: str, tasks: dict) -> dict:
    queries = _file(spark, *(f"{qid}:{q}" for qid, q in BATCH.items()))
    return {"queryFilePath": queries} | tasks | {"task_9:output": {"type": "trec_eval", "outputPath": path, "outputLength": 20}}


_BM25 = {"type": "BM25", "BM25:k_1": 1.2, "BM25:b": 0.75, "outputLength": 100}


@_query("pipeline_run", oracle.ranking(_EVAL, after="SELECT qid, ext_id, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT '5', 'Nonexistent_Docid', 1"))
def pipeline_run(spark, sf_dir):
    """A ranker and an output, whose length is the ranker's depth, too."""
    path = f"{scratch(spark)}/out.teIn"
    pipeline.run(spark, _case(spark, path, {"task_1:ranker": _BM25}), documents(spark, sf_dir))
    return trec.read_run(spark, path).select("qid", "ext_id", "rank")


@_query("pipeline_reranked", oracle.ranking(_EVAL, after="""SELECT qid, ext_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank > 5, CASE WHEN rank <= 5 THEN -len(ws) END, CASE WHEN rank > 5 THEN rank END, r.docid) AS INTEGER) AS rank
  FROM ranked r JOIN w ON w.docid = r.docid WHERE rank <= 20 UNION ALL SELECT '5', 'Nonexistent_Docid', 1"""))
def pipeline_reranked(spark, sf_dir):
    """A reranker of one's own by its type: the five best by length, the rest behind."""
    index, path = documents(spark, sf_dir), f"{scratch(spark)}/out.teIn"
    case = _case(spark, path, {"task_1:ranker": _BM25, "task_2:reranker": {"type": "length", "rerankDepth": 5}})
    pipeline.run(spark, case, index, {"length": linear_scorer(index, {"length:body": 1.0})})
    return trec.read_run(spark, path).select("qid", "ext_id", "rank")


@_query("depths", _values("name, depth", [("own output", 50), ("first of two", 50), ("none", 1000)]))
def depths(spark, sf_dir):
    """The depth of rankers: the first output's length, wherever it stands."""
    out = lambda n: {"type": "trec_eval", "outputLength": n}
    cases = [("own output", {"task_1:ranker": {}, "task_2:output": out(50)}), ("first of two", {"task_5:output": out(50), "task_1:output": out(10)}), ("none", {"task_1:ranker": {}})]
    return spark.createDataFrame([(name, pipeline.output_length(p)) for name, p in cases], "name string, depth int")


@_query("golden_lines", _values("metric, qid, value", [("P_10", "all", "0.5")]))
def golden_lines(spark, sf_dir):
    """Expected lines over all queries that a metric file lacks; lines by query don't count."""
    want = trec.read_metrics(spark, _file(spark, "map all 0.25", "P_10 all 0.5", "map 1 0.9"), "want")
    got = trec.read_metrics(spark, _file(spark, "map all 0.25", "P_10 all 0.4", "P_20 all 0.1"), "got")
    return evaluate.missing_lines(want, got)


@_query("experiment_compared", _values("name, qid, outcome", [("same", q, "TIE") for q in _EVAL]))
def experiment_compared(spark, sf_dir):
    """A run's file against a baseline's."""
    path = f"{scratch(spark)}/out.teIn"
    pipeline.run(spark, _case(spark, path, {"task_1:ranker": _BM25}), documents(spark, sf_dir))
    found = experiments.compare(spark, _judgements(spark, sf_dir, _EVAL), path, {"same": path})["same"]
    return found.select(F.lit("same").alias("name"), "qid", "outcome")


