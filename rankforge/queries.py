"""Queries over the driver's tables: each operator of the engine by name, and its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge import oracle
from rankforge.functions.analysis import Analyzer
from rankforge.operators import evaluate, inspect, models, prf
from rankforge.operators.rank import rank, top_distinct
from rankforge.operators.rerank import linear_scorer, rerank
from rankforge.plans.compile import postings_of
from rankforge.plans.parser import parse
from rankforge.plans.rewrite import optimize
from rankforge.sources import trec
from rankforge.sources.corpus import Corpus, from_documents, from_pages, scratch
from rankforge.sources.index import Index

QUERIES, ORACLES = {}, {}
BATCH = {"1": "th er", "2": "#and(ha nd)", "3": "#wsum(0.7 thth 0.3 thon)", "4": "#near/8(th er)", "5": "the of"}
PRF_QUERY = {"1": "#sum(thth thon)", "2": "#sum(th ha)"}


def documents(spark: SparkSession, sf_dir: str, analyzer: Analyzer | None = None) -> Index:
    return Index.build(from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), analyzer)


def pages(spark: SparkSession, sf_dir: str) -> Index:
    return Index.build(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _retrieval(name: str, queries: dict[str, str] | str, model, k: int = 10) -> None:
    batch = {"1": queries} if isinstance(queries, str) else queries
    _query(name, oracle.ranking(batch, type(model).__name__, k))(lambda spark, sf_dir: rank(documents(spark, sf_dir), batch, model, k, digits=6))


def _positional(name: str, query: str) -> None:
    @_query(name, oracle.inverted_list(query))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = documents(spark, sf_dir)
        found = postings_of(index, {"1": optimize(parse(query, index.analyzer))})
        listed = F.array_join(F.array_sort("positions").cast("array<string>"), ",")
        return found.select("docid", F.col("tf").cast("long").alias("tf"), listed.alias("positions"))


# Index and inspection.
_T = f"WITH {oracle.tables()} "
_STATS = "SELECT field, count(*) AS total, count(DISTINCT docid) AS doc_count, round(count(*) * 1.0 / count(DISTINCT docid), 6) AS average FROM kept GROUP BY field"
_PAGE_TEXTS = r"""SELECT page_id AS docid, 'url' AS field, url AS text FROM pages UNION ALL
  SELECT page_id, 'title', regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) FROM pages UNION ALL
  SELECT page_id, 'body', regexp_replace(regexp_replace(html, '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '<[^>]*>', ' ', 'g') FROM pages"""
_PAGES = oracle.tables(_PAGE_TEXTS, "pages")


@_query("corpus_stats", _T + "SELECT s.*, n AS num_docs FROM (" + _STATS + ") s, nd")
def corpus_stats(spark, sf_dir):
    index = documents(spark, sf_dir)
    return _rounded(inspect.list_stats(index), "average").crossJoin(index.docs.agg(F.count("*").alias("num_docs")))  # one row by one row for each field


@_query("field_stats_pages", f"WITH {_PAGES} " + _STATS)
def field_stats_pages(spark, sf_dir):
    return _rounded(inspect.list_stats(pages(spark, sf_dir)), "average")


@_query("list_fields_pages", f"WITH {_PAGES} SELECT DISTINCT field FROM w")
def list_fields_pages(spark, sf_dir):
    return inspect.list_fields(pages(spark, sf_dir))


@_query("term_dictionary", _T + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM p WHERE field = 'body' GROUP BY term")
def term_dictionary(spark, sf_dir):
    return inspect.list_terms(documents(spark, sf_dir), "body")


@_query("term_dictionary_stemmed", f"WITH {oracle.tables(stem=True)} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM p WHERE field = 'body' GROUP BY term")
def term_dictionary_stemmed(spark, sf_dir):
    return inspect.list_terms(documents(spark, sf_dir, Analyzer(stem="s")), "body")


_LISTED = "CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions"


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@_query("postings_th", _T + f"SELECT docid, {_LISTED} FROM kept WHERE term = 'th' GROUP BY docid")
def postings_th(spark, sf_dir):
    return _listed(inspect.list_postings(documents(spark, sf_dir), "th", "body"))


@_query("postings_sample", _T + f"SELECT docid, {_LISTED} FROM kept WHERE term = 'th' GROUP BY docid ORDER BY docid LIMIT 5")
def postings_sample(spark, sf_dir):
    return _listed(inspect.list_postings(documents(spark, sf_dir), "th", "body", 5))


@_query("postings_head", _T + "SELECT count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM p WHERE term = 'er'")
def postings_head(spark, sf_dir):
    return inspect.list_postings_head(documents(spark, sf_dir), "er", "body")


@_query("termvector_doc", _T + f"SELECT field, term, {_LISTED} FROM kept WHERE docid = 7 GROUP BY field, term")
def termvector_doc(spark, sf_dir):
    return _listed(inspect.list_term_vector(documents(spark, sf_dir), 7))


@_query("list_docids", "SELECT doc_id AS docid, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS ext_id FROM documents")
def list_docids(spark, sf_dir):
    return inspect.list_docids(documents(spark, sf_dir))


@_query("list_attribute", "SELECT doc_id AS docid, source AS value FROM documents WHERE doc_id = 7")
def list_attribute(spark, sf_dir):
    return inspect.list_attribute(documents(spark, sf_dir), 7, "source")


@_query("list_metadata", "SELECT 'lang' AS name, lang AS value FROM documents WHERE doc_id = 7 UNION ALL SELECT 'source', source FROM documents WHERE doc_id = 7")
def list_metadata(spark, sf_dir):
    return inspect.list_metadata(documents(spark, sf_dir), 7)


@_query("list_doc", "SELECT doc_id AS docid, 'doc-00000007' AS ext_id, lang, source FROM documents WHERE doc_id = 7")
def list_doc(spark, sf_dir):
    return inspect.list_doc(documents(spark, sf_dir), 7).select("docid", "ext_id", F.col("attrs")["lang"].alias("lang"), F.col("attrs")["source"].alias("source"))


@_query("list_external_id", "SELECT doc_id AS docid, 'doc-00000009' AS ext_id FROM documents WHERE doc_id = 9")
def list_external_id(spark, sf_dir):
    return inspect.list_external(documents(spark, sf_dir), 9)


@_query("termvector_field", f"WITH {_PAGES} SELECT field, term, {_LISTED} FROM kept WHERE docid = 3 AND field = 'title' GROUP BY field, term")
def termvector_field(spark, sf_dir):
    return _listed(inspect.list_term_vector(pages(spark, sf_dir), 3, "title"))


@_query("list_internal_id", "SELECT doc_id AS docid, 'doc-00000007' AS ext_id FROM documents WHERE doc_id = 7")
def list_internal_id(spark, sf_dir):
    return inspect.list_internal(documents(spark, sf_dir), "doc-00000007")


@_query("doc_length", _T + "SELECT w.docid, w.field, CAST(len(ws) AS INTEGER) AS len_all, CAST(coalesce(m, -1) + 1 AS INTEGER) AS len_positions, CAST(coalesce(n, 0) AS INTEGER) AS n_indexed FROM w LEFT JOIN (SELECT docid, field, max(pos) AS m, count(*) AS n FROM kept GROUP BY docid, field) k ON w.docid = k.docid AND w.field = k.field")
def doc_length(spark, sf_dir):
    return documents(spark, sf_dir).doc_len


# Position operators.
_positional("iop_term", "thth")
_positional("iop_syn", "#syn(thth thon rewh)")
_positional("iop_near_2", "#near/8(th er)")
_positional("iop_near_3", "#near/20(th er ha)")
_positional("iop_near_nested", "#near/30(#near/8(th er) ha)")
_positional("iop_near_of_syn", "#near/2(#syn(th nd) #syn(er ha))")
_positional("iop_window", "#window/8(th er)")
_positional("iop_window_nested", "#window/12(#near/8(th er) ha)")
_positional("iop_window_3", "#window/16(th er ha)")

# Score operators and models.
_retrieval("bool_and", "#and(th er ha)", models.UnrankedBoolean())
_retrieval("bool_or", "#or(thth thon orre)", models.UnrankedBoolean())
_retrieval("bool_sum", "#sum(th er ha)", models.UnrankedBoolean())
_retrieval("bool_near", "#near/8(th er)", models.UnrankedBoolean(), 100)
_retrieval("ranked_and", "#and(th er ha)", models.RankedBoolean())
_retrieval("ranked_or", "#or(thth thon orre)", models.RankedBoolean())
_retrieval("ranked_near", "#and(#near/8(th er) ha)", models.RankedBoolean())
_retrieval("bm25_term", "thth", models.BM25())
_retrieval("bm25_sum", "#sum(th er ha)", models.BM25())
_retrieval("bm25_wsum", "#wsum(0.5 th 0.3 er 0.2 ha)", models.BM25())
_retrieval("bm25_and", "#and(th er ha)", models.BM25())
_retrieval("bm25_or", "#or(thth thon orre)", models.BM25())
_retrieval("bm25_near", "#sum(#near/8(th er) #near/8(nd ha))", models.BM25())
_retrieval("bm25_syn", "#sum(#syn(thth thon) rewh)", models.BM25())
_retrieval("bm25_window", "#sum(#window/8(th er) ha)", models.BM25())
_retrieval("bm25_nested", "#and(#or(thth thon) #sum(th #near/8(nd ha)))", models.BM25())
_retrieval("sum_duplicates", "#sum(th er th)", models.BM25())
_retrieval("rank_topk_batch", BATCH, models.BM25(), 20)
_retrieval("rank_ties", "#or(th er)", models.RankedBoolean(), 50)
_retrieval("pruned_tree", "#AND(#Or(THTH the thon) #sum( #and(of) #sum(Th) ha #syn(nd)))", models.BM25())
_retrieval("stopword_gaps", "#near/2(th of er)", models.RankedBoolean())


def _pages_query(name: str, query: str) -> None:
    _query(name, oracle.ranking({"1": query}, base=_PAGES, prefix="page-"))(lambda spark, sf_dir: rank(pages(spark, sf_dir), {"1": query}, models.BM25(), 10, digits=6))


_pages_query("bm25_title", "#sum(th.title er.title)")
_pages_query("bm25_multifield", "#wsum(0.6 th.body 0.3 th.title 0.1 er.body)")


@_query("bm25_params", oracle.ranking({"1": "th er"}).replace("1.2 * (0.25 + 0.75", "0.9 * (0.6 + 0.4").replace("(tf * 2.2)", "(tf * 1.9)"))
def bm25_params(spark, sf_dir):
    return rank(documents(spark, sf_dir), {"1": "th er"}, models.from_parameters({"type": "BM25", "BM25:k_1": "0.9", "BM25:b": "0.4"}), 10, digits=6)


@_query("rank_distinct", "WITH s AS (SELECT lang AS qid, doc_id AS docid, source AS ext_id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents) SELECT qid, docid, ext_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM s WHERE n = 1) WHERE rank <= 5")
def rank_distinct(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return top_distinct(d.select(F.col("lang").alias("qid"), F.col("doc_id").alias("docid"), F.col("source").alias("ext_id"), F.col("n_chars").cast("double").alias("score")), 5)


# Feedback. Scores are rounded before terms are chosen, here and in SQL.
_DOCS, _TERMS = 5, 8


def _prf_sql(algorithm: str, after: str) -> str:
    score = "tf / (tf + 0.5 + 1.5 * length / (SELECT average FROM st)) * ln(((SELECT n FROM nd) - df + 0.5) / (df + 0.5))" if algorithm == "okapi" else "tf * 1.0 / length * wt"
    tail = f"""best AS (SELECT qid, docid, rank, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM ranked WHERE rank <= {_DOCS}),
    wts AS (SELECT qid, docid, rank, e / sum(e) OVER (PARTITION BY qid) AS wt FROM best),
    lens AS (SELECT docid, max(pos) + 1 AS length FROM kept GROUP BY docid),
    dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    ts AS (SELECT qid, p.term, round(sum({score}), 9) AS score FROM wts JOIN p ON p.docid = wts.docid JOIN lens ON lens.docid = wts.docid JOIN dfs ON dfs.term = p.term
      WHERE NOT regexp_matches(p.term, '[.,]') AND regexp_full_match(p.term, '[\\x00-\\x7F]*') GROUP BY qid, p.term),
    sel AS (SELECT qid, term, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, term) AS r FROM ts) WHERE r <= {_TERMS})"""
    whole = oracle.ranking(PRF_QUERY, after="@")
    return whole[:-2].rstrip() + ", " + tail + " " + after


_SELECTED = "SELECT qid, term, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, term) AS INTEGER) AS place FROM sel"


def _feedback(spark, sf_dir, algorithm: str):
    index = documents(spark, sf_dir)
    f = prf.Feedback(algorithm, _DOCS, _TERMS)
    best = rank(index, PRF_QUERY, models.BM25(), 100, digits=6)
    return index, f, prf.select_terms(_rounded(prf.term_scores(index, best, f), "score", digits=9), _TERMS)


@_query("prf_okapi_terms", _prf_sql("okapi", _SELECTED))
def prf_okapi_terms(spark, sf_dir):
    return _rounded(_feedback(spark, sf_dir, "okapi")[2], "score")


@_query("prf_rm3_terms", _prf_sql("rm3", _SELECTED))
def prf_rm3_terms(spark, sf_dir):
    return _rounded(_feedback(spark, sf_dir, "rm3")[2], "score")


@_query("prf_learned_query", _prf_sql("okapi", "SELECT qid, '#sum (' || string_agg(term, ' ' ORDER BY score, term) || ')' AS learned FROM sel GROUP BY qid"))
def prf_learned_query(spark, sf_dir):
    _, f, selected = _feedback(spark, sf_dir, "okapi")
    return prf.learned_queries(selected, f)


@_query("prf_learned_rm3", _prf_sql("rm3", "SELECT qid, '#wsum (' || string_agg(printf('%.6f', score / total) || ' ' || term, ' ' ORDER BY score, term) || ')' AS learned FROM (SELECT *, sum(score) OVER (PARTITION BY qid) AS total FROM sel) GROUP BY qid"))
def prf_learned_rm3(spark, sf_dir):
    _, f, selected = _feedback(spark, sf_dir, "rm3")
    return prf.learned_queries(selected, f)


# The expanded query is #wsum(0.5 #sum(original) 0.5 #wsum(weights and terms learned)).
_SECOND = """tot AS (SELECT qid, sum(score) AS total FROM sel GROUP BY qid),
    ws AS (SELECT sel.qid, term, 0.5 * CAST(printf('%.6f', score / total) AS DOUBLE) AS wt FROM sel JOIN tot ON tot.qid = sel.qid
      UNION ALL SELECT qid, term, 0.5 FROM (VALUES ('1', 'thth'), ('1', 'thon'), ('2', 'th'), ('2', 'ha')) o(qid, term)),
    b AS (SELECT ws.qid, p.docid, wt * ln(((SELECT n FROM nd) - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w.ws) / (SELECT average FROM st))) AS s
      FROM ws JOIN p ON p.term = ws.term JOIN dfs ON dfs.term = p.term JOIN w ON w.docid = p.docid),
    r AS (SELECT qid, docid, round(CAST(sum(s) AS DOUBLE), 6) AS score FROM b GROUP BY qid, docid)
    SELECT qid, docid, 'doc-' || lpad(CAST(docid AS VARCHAR), 8, '0') AS ext_id, score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM r) WHERE rank <= 20"""


@_query("prf_second_pass", _prf_sql("rm3", "@").removesuffix("@").rstrip() + ", " + _SECOND)
def prf_second_pass(spark, sf_dir):
    index, f, selected = _feedback(spark, sf_dir, "rm3")
    found = {r.qid: r.learned for r in prf.learned_queries(selected, f).collect()}
    expanded = {qid: prf.expand(q, found.get(qid), prf.Feedback("rm3", _DOCS, _TERMS, orig_weight=0.5)) for qid, q in PRF_QUERY.items()}
    return rank(index, expanded, models.BM25(), 20, digits=6)


# Reranking: longest documents first, the tail shifted below.
_RERANK = """best AS (SELECT qid, r.docid, ext_id, CAST(len(ws) AS DOUBLE) AS score FROM ranked r JOIN w ON w.docid = r.docid WHERE rank <= 5),
 low AS (SELECT qid, min(score) AS low FROM best GROUP BY qid),
 tail AS (SELECT ranked.*, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS head FROM ranked WHERE rank BETWEEN 6 AND 20),
 moved AS (SELECT t.qid, docid, ext_id, score - greatest(0.0, head + 0.1 - low) AS score, rank AS o FROM tail t JOIN low ON low.qid = t.qid)
 SELECT qid, docid, ext_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY part, CASE WHEN part = 0 THEN -score END, o, docid) AS INTEGER) AS rank
 FROM (SELECT *, 0 AS o, 0 AS part FROM best UNION ALL SELECT *, 1 AS part FROM moved)"""


@_query("rerank_merge", oracle.ranking(PRF_QUERY, after="@")[:-2].rstrip() + ", " + _RERANK)
def rerank_merge(spark, sf_dir):
    index = documents(spark, sf_dir)
    best = rank(index, PRF_QUERY, models.BM25(), 20, digits=6)
    return _rounded(rerank(best, linear_scorer(index, {"length:body": 1.0}), 5), "score")


# Runs and evaluation.
_LINES = "SELECT qid, CAST(rank AS INTEGER) AS rank, qid || ' Q0 ' || ext_id || ' ' || rank || ' ' || printf('%.12f', score) || ' reference' AS line FROM ranked WHERE rank <= 20"


@_query("run_placeholder", oracle.ranking({k: v for k, v in BATCH.items() if k != "5"}, after=_LINES + " UNION ALL SELECT '5', 1, '5 Q0 Nonexistent_Docid 1 0.000000000000 reference'"))
def run_placeholder(spark, sf_dir):
    found = rank(documents(spark, sf_dir), BATCH, models.BM25(), 20, digits=6)
    lines = trec.run_lines(found, list(BATCH), 20)
    return lines.select(F.split("line", " ")[0].alias("qid"), F.col("rank").cast("int").alias("rank"), "line")


@_query("run_roundtrip", oracle.ranking({k: v for k, v in BATCH.items() if k != "5"}, k=20, after="SELECT qid, ext_id, score, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT '5', 'Nonexistent_Docid', 0.0, 1"))
def run_roundtrip(spark, sf_dir):
    found = rank(documents(spark, sf_dir), BATCH, models.BM25(), 20, digits=6)
    path = f"{scratch(spark)}/run.teIn"
    trec.write_run(found, list(BATCH), path, 20)
    return trec.read_run(spark, path).select("qid", "ext_id", "score", "rank")


_QRELS = "q AS (SELECT qid, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS ext_id, quality AS rel FROM labels, (SELECT DISTINCT qid FROM ranked))"
_JUDGED = """j AS (SELECT r.qid, r.ext_id, coalesce(q.rel, 0) AS rel, row_number() OVER (PARTITION BY r.qid ORDER BY score DESC, r.ext_id DESC) AS place
   FROM (SELECT * FROM ranked WHERE rank <= 100) r LEFT JOIN q ON q.qid = r.qid AND q.ext_id = r.ext_id),
 h AS (SELECT *, CASE WHEN rel > 0 THEN 1 ELSE 0 END AS hit, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY place) AS hits FROM j),
{ideal}, {measures}"""
_CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
_ALL = {"map": "sum(hit * hits * 1.0 / place) / any_value(num_rel)", "map_cut_1000": "sum(CASE WHEN place <= 1000 THEN hit * hits * 1.0 / place END) / any_value(num_rel)", "recip_rank": "coalesce(1.0 / min(CASE WHEN hit = 1 THEN place END), 0.0)"}
_ALL |= {"ndcg": "sum(rel / log2(place + 1.0)) / any_value(ideal)", "num_ret": "count(*)", "num_rel": "any_value(num_rel)", "num_rel_ret": "sum(hit)"}
_ALL |= {f"P_{k}": f"sum(CASE WHEN place <= {k} THEN hit ELSE 0 END) / {k}.0" for k in _CUTS} | {f"ndcg_cut_{k}": f"sum(CASE WHEN place <= {k} THEN rel / log2(place + 1.0) ELSE 0 END) / any_value(ideal_{k})" for k in _CUTS}
_ALL |= {f"recall_{k}": f"sum(CASE WHEN place <= {k} THEN hit ELSE 0 END) * 1.0 / any_value(num_rel)" for k in (100, 500, 1000)}
_IDEAL = "i AS (SELECT qid, count(*) AS num_rel, sum(rel / log2(place + 1.0)) AS ideal, " + ", ".join(f"sum(CASE WHEN place <= {k} THEN rel / log2(place + 1.0) END) AS ideal_{k}" for k in _CUTS)
_IDEAL += " FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, ext_id) AS place FROM q WHERE rel > 0) GROUP BY qid)"
_JUDGED = _JUDGED.format(ideal=_IDEAL, measures="m AS (SELECT h.qid, " + ", ".join(f"{x} AS {c}" for c, x in _ALL.items()) + " FROM h JOIN i ON i.qid = h.qid GROUP BY h.qid)")
_EVAL = {k: v for k, v in BATCH.items() if k != "5"}


def _eval_sql(after: str, queries=_EVAL) -> str:
    return oracle.ranking(queries, after="@")[:-2].rstrip() + f", {_QRELS}, {_JUDGED} " + after


def _judgements(spark, sf_dir, qids) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ext = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return labels.select(F.explode(F.array(*map(F.lit, qids))).alias("qid"), F.lit("0").alias("iter"), ext.alias("ext_id"), F.col("quality").cast("int").alias("rel"))


def _run(spark, sf_dir, queries=_EVAL, model=None) -> DataFrame:
    return rank(documents(spark, sf_dir), queries, model or models.BM25(), 100, digits=6)


_COUNTS = ("num_ret", "num_rel", "num_rel_ret")
_LONG = "SELECT 'num_q' AS metric, 'all' AS qid, CAST(count(*) AS DOUBLE) AS value FROM m" + "".join(
    f" UNION ALL SELECT '{c}', qid, round(CAST({c} AS DOUBLE), 6) FROM m UNION ALL SELECT '{c}', 'all', round(CAST({'sum' if c in _COUNTS else 'avg'}({c}) AS DOUBLE), 6) FROM m" for c in _ALL
)
_LABELS = "(VALUES ('MRR', 'recip_rank'), ('P@10', 'P_10'), ('P@20', 'P_20'), ('P@30', 'P_30'), ('MAP@1K', 'map_cut_1000'), ('NDCG@10', 'ndcg_cut_10'), ('NDCG@20', 'ndcg_cut_20'), ('NDCG@30', 'ndcg_cut_30'), ('R@100', 'recall_100'), ('R@1000', 'recall_1000')) l(label, metric)"


@_query("eval_metrics", _eval_sql(_LONG))
def eval_metrics(spark, sf_dir):
    """Every measure of every query, and over all."""
    return _rounded(evaluate.measures(_run(spark, sf_dir), _judgements(spark, sf_dir, _EVAL)), "value")


@_query("eval_labelled", _eval_sql(f"SELECT label, printf('%.4f', value) AS value FROM {_LABELS} JOIN ({_LONG}) e ON e.metric = l.metric AND e.qid = 'all'"))
def eval_labelled(spark, sf_dir):
    return evaluate.labelled(evaluate.measures(_run(spark, sf_dir), _judgements(spark, sf_dir, _EVAL)))


@_query("eval_map_per_query", _eval_sql("SELECT qid, CAST(round(map, 6) AS DOUBLE) AS map FROM m"))
def eval_map_per_query(spark, sf_dir):
    return _rounded(evaluate.map_per_query(_run(spark, sf_dir), _judgements(spark, sf_dir, _EVAL)), "map")


@_query("win_tie_loss", _eval_sql("""SELECT b.qid, CAST(round(b.map, 6) AS DOUBLE) AS base, CAST(round(coalesce(e.map, 0), 6) AS DOUBLE) AS exp,
  CASE WHEN (CASE WHEN b.map <> 0 THEN (coalesce(e.map, 0) - b.map) / b.map WHEN e.map > 0 THEN 1e9 ELSE 0 END) >= 0.02 THEN 'WIN'
       WHEN (CASE WHEN b.map <> 0 THEN (coalesce(e.map, 0) - b.map) / b.map WHEN e.map > 0 THEN 1e9 ELSE 0 END) <= -0.02 THEN 'LOSS' ELSE 'TIE' END AS outcome
  FROM (SELECT * FROM m WHERE qid IN ('1', '2', '3')) b LEFT JOIN (SELECT CAST(CAST(qid AS INTEGER) - 1 AS VARCHAR) AS qid, map FROM m WHERE qid <> '1') e ON b.qid = e.qid"""))
def win_tie_loss(spark, sf_dir):
    """Each query against the next one: two runs of one batch."""
    found = evaluate.map_per_query(_run(spark, sf_dir), _judgements(spark, sf_dir, _EVAL))
    other = found.where("qid <> '1'").select((F.col("qid").cast("int") - 1).cast("string").alias("qid"), "map")
    return _rounded(evaluate.win_tie_loss(found.where("qid IN ('1', '2', '3')"), other), "base", "exp")


@_query("metrics_pivot", _eval_sql("SELECT 'map' AS metric, qid, CAST(round(map, 6) AS DOUBLE) AS a, CAST(round(map * 2, 6) AS DOUBLE) AS b FROM m"))
def metrics_pivot(spark, sf_dir):
    found = evaluate.map_per_query(_run(spark, sf_dir), _judgements(spark, sf_dir, _EVAL))
    rows = found.select(F.lit("map").alias("metric"), "qid", F.explode(F.array(F.struct(F.lit("a").alias("run"), F.col("map").alias("value")), F.struct(F.lit("b").alias("run"), (F.col("map") * 2).alias("value")))).alias("r"))
    return _rounded(evaluate.pivot(rows.select("r.run", "metric", "qid", "r.value"), ["a", "b"]), "a", "b")


# A written index: its tables sorted by term and by document, and its statistics.
def _written(spark, sf_dir) -> Index:
    path = f"{scratch(spark)}/index"
    documents(spark, sf_dir).write(path)
    return Index.open(spark, path)


@_query("index_reopened", _T + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM p WHERE term IN ('th', 'er', 'thth') GROUP BY term")
def index_reopened(spark, sf_dir):
    """Counted over the posting lists of an opened index, not read from its statistics."""
    index = _written(spark, sf_dir)
    lists = [index.posting_list(t).select("term", "tf") for t in ("th", "er", "thth", "absent")]
    index.close()
    return reduce(DataFrame.unionByName, lists).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))


@_query("index_statistics", _T + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM p WHERE field = 'body' GROUP BY term")
def index_statistics(spark, sf_dir):
    return inspect.list_terms(_written(spark, sf_dir), "body")


@_query("index_vectors", _T + f"SELECT field, term, {_LISTED} FROM kept WHERE docid = 7 GROUP BY field, term")
def index_vectors(spark, sf_dir):
    return _listed(inspect.list_term_vector(_written(spark, sf_dir), 7))


@_query("ranked_from_store", oracle.ranking(BATCH, k=20))
def ranked_from_store(spark, sf_dir):
    return rank(_written(spark, sf_dir), BATCH, models.BM25(), 20, digits=6)


@_query("prf_from_store", _prf_sql("okapi", _SELECTED))
def prf_from_store(spark, sf_dir):
    index, f = _written(spark, sf_dir), prf.Feedback("okapi", _DOCS, _TERMS)
    best = rank(index, PRF_QUERY, models.BM25(), 100, digits=6)
    return _rounded(prf.select_terms(_rounded(prf.term_scores(index, best, f), "score", digits=9), _TERMS), "score")


@_query("rank_repeated_ids", oracle.ranking({"1": "#or(thth thon orre)"}, after="""SELECT '1' AS qid, docid, source AS ext_id, score, CAST(row_number() OVER (ORDER BY score DESC, docid) AS INTEGER) AS rank FROM
  (SELECT s.docid, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, s.docid) AS n FROM scored s JOIN documents d ON d.doc_id = s.docid) WHERE n = 1 ORDER BY score DESC, docid LIMIT 5"""))
def rank_repeated_ids(spark, sf_dir):
    """An index whose external ids are the sources."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus = from_documents(table)
    named = table.select(F.col("doc_id").cast("long").alias("docid"), F.col("source").alias("ext_id")).join(corpus.docs.drop("ext_id"), "docid")
    return rank(Index.build(Corpus(named, corpus.fields)), {"1": "#or(thth thon orre)"}, models.BM25(), 5, digits=6, repeated_ids=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of a sum of three terms: the ten best documents."""
    return rank(documents(spark, sf_dir), {"1": "#sum(th er ha)"}, models.BM25(), 10)
