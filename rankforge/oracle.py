"""DuckDB SQL for query trees and index tables: an independent way to the results of the registered queries."""

from __future__ import annotations

from rankforge.plans.tree import Node

# Fixed values, written down a second time: the SQL takes nothing from the analyzer, the parser or the rewrites.
_STOP = "'a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with'"
_PATTERN = r"[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*"


def _t(term: str, field: str = "body") -> Node:
    return Node("TERM", term=term, field=field)


def _over(op: str, *args: Node | str, n: int | None = None, weights: tuple[float, ...] = ()) -> Node:
    """An operator over trees or terms; a score operator scores what has positions."""
    nodes = [_t(a) if isinstance(a, str) else a for a in args]
    if op in ("AND", "OR", "SUM", "WSUM"):
        nodes = [Node("SCORE", [a]) if a.op in ("TERM", "SYN", "NEAR", "WINDOW") else a for a in nodes]
    return Node(op, nodes, list(weights), n)


def _alone(arg: Node | str) -> Node:
    return Node("SCORE", [_t(arg) if isinstance(arg, str) else arg])


_NEAR8, _NEAR8B = _over("NEAR", "th", "er", n=8), _over("NEAR", "nd", "ha", n=8)
#: The trees of all registered queries as they should be run, by hand.
TREES: dict[str, Node | None] = {
    "th er": _over("SUM", "th", "er"), "#and(ha nd)": _over("AND", "ha", "nd"), "#wsum(0.7 thth 0.3 thon)": _over("WSUM", "thth", "thon", weights=(0.7, 0.3)), "#near/8(th er)": _alone(_NEAR8), "the of": None,
    "#sum(thth thon)": _over("SUM", "thth", "thon"), "#sum(th ha)": _over("SUM", "th", "ha"),
    "thth": _alone("thth"), "#syn(thth thon rewh)": _alone(_over("SYN", "thth", "thon", "rewh")), "#near/20(th er ha)": _alone(_over("NEAR", "th", "er", "ha", n=20)),
    "#near/30(#near/8(th er) ha)": _alone(_over("NEAR", _NEAR8, "ha", n=30)), "#near/2(#syn(th nd) #syn(er ha))": _alone(_over("NEAR", _over("SYN", "th", "nd"), _over("SYN", "er", "ha"), n=2)),
    "#window/8(th er)": _alone(_over("WINDOW", "th", "er", n=8)), "#window/12(#near/8(th er) ha)": _alone(_over("WINDOW", _NEAR8, "ha", n=12)), "#window/16(th er ha)": _alone(_over("WINDOW", "th", "er", "ha", n=16)),
    "#and(th er ha)": _over("AND", "th", "er", "ha"), "#or(thth thon orre)": _over("OR", "thth", "thon", "orre"), "#sum(th er ha)": _over("SUM", "th", "er", "ha"), "#and(#near/8(th er) ha)": _over("AND", _NEAR8, "ha"),
    "#wsum(0.5 th 0.3 er 0.2 ha)": _over("WSUM", "th", "er", "ha", weights=(0.5, 0.3, 0.2)), "#sum(#near/8(th er) #near/8(nd ha))": _over("SUM", _NEAR8, _NEAR8B),
    "#sum(#syn(thth thon) rewh)": _over("SUM", _over("SYN", "thth", "thon"), "rewh"), "#sum(#window/8(th er) ha)": _over("SUM", _over("WINDOW", "th", "er", n=8), "ha"),
    "#and(#or(thth thon) #sum(th #near/8(nd ha)))": _over("AND", _over("OR", "thth", "thon"), _over("SUM", "th", _NEAR8B)), "#sum(th er th)": _over("WSUM", "th", "er", weights=(2.0, 1.0)),
    "#or(th er)": _over("OR", "th", "er"), "#near/2(th of er)": _alone(_over("NEAR", "th", "er", n=2)), "#sum(th.title er.title)": _over("SUM", _t("th", "title"), _t("er", "title")),
    "#wsum(0.6 th.body 0.3 th.title 0.1 er.body)": _over("WSUM", "th", _t("th", "title"), "er", weights=(0.6, 0.3, 0.1)),
    "#AND(#Or(THTH the thon) #sum( #and(of) #sum(Th) ha #syn(nd)))": _over("AND", _over("OR", "thth", "thon"), _over("SUM", "th", "ha", "nd")),
}


def tables(text: str = "SELECT doc_id AS docid, 'body' AS field, text FROM documents", docs: str = "documents", stem: bool = False) -> str:
    """CTEs: w (words of each text), kept (indexed tokens), p (postings without positions), st (statistics by field)."""
    term = "term"
    if stem:
        term = """CASE WHEN term LIKE '%ies' AND NOT regexp_matches(term, '[ea]ies$') THEN left(term, length(term) - 3) || 'y'
          WHEN term LIKE '%es' AND NOT regexp_matches(term, '[aeo]es$') THEN left(term, length(term) - 1)
          WHEN term LIKE '%s' AND NOT regexp_matches(term, '[us]s$') THEN left(term, length(term) - 1) ELSE term END AS term"""
    return f"""f AS ({text}),
    w AS (SELECT docid, field, regexp_extract_all(lower(coalesce(text, '')), '{_PATTERN}') AS ws FROM f),
    tok AS (SELECT docid, field, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM w),
    kept AS (SELECT docid, field, {term}, CAST(pos AS INTEGER) AS pos FROM tok WHERE term NOT IN ({_STOP})),
    p AS (SELECT field, term, docid, count(*) AS tf FROM kept GROUP BY ALL),
    st AS (SELECT field, count(*) * 1.0 / count(DISTINCT docid) AS average FROM kept GROUP BY field),
    nd AS (SELECT count(*) AS n FROM {docs})"""


class Sql:
    """CTEs of one tree: position operators as (docid, pos), a row for each position; score operators as (docid, score)."""

    def __init__(self, model: str = "BM25", k1: float = 1.2, b: float = 0.75):
        self.model, self.k1, self.b, self.ctes = model, k1, b, []

    def _add(self, body: str) -> str:
        name = f"t{len(self.ctes)}"
        self.ctes.append(f"{name} AS ({body})")
        return name

    def visit(self, node: Node) -> str:
        if node.op == "TERM":
            return self._add(f"SELECT docid, pos FROM kept WHERE field = '{node.field}' AND term = '{node.term}'")
        args = [self.visit(a) for a in node.args]
        if node.op == "SYN":
            return self._add(" UNION ".join(f"SELECT docid, pos FROM {a}" for a in args))
        if node.op == "NEAR":
            last = args[0]
            for a in args[1:]:
                last = self._add(f"SELECT y.docid, y.pos FROM {last} x JOIN {a} y ON x.docid = y.docid AND y.pos > x.pos AND y.pos - x.pos <= {node.n}")
            return last
        if node.op == "WINDOW":
            lists = [self._add(f"SELECT docid, list(pos ORDER BY pos) AS l FROM {x} GROUP BY docid") for x in args]
            ks = range(len(lists))
            both = self._add(f"SELECT l0.docid, {', '.join(f'l{k}.l AS p{k}' for k in ks)} FROM {lists[0]} l0 " + " ".join(f"JOIN {x} l{k} ON l{k}.docid = l0.docid" for k, x in enumerate(lists) if k))
            name, at, held = f"t{len(self.ctes)}", [f"p{k}[i{k}]" for k in ks], ", ".join(f"p{k}" for k in ks)
            low, high, more = f"least({', '.join(at)})", f"greatest({', '.join(at)})", " AND ".join(f"i{k} <= len(p{k})" for k in ks)
            match = f"{high} - {low} < {node.n}"
            self.ctes.append(
                f"""{name}_walk AS (SELECT docid, {held}, {', '.join(f'1 AS i{k}' for k in ks)} FROM {both} UNION ALL
                SELECT docid, {held}, {', '.join(f'CASE WHEN {match} OR {at[k]} = {low} THEN i{k} + 1 ELSE i{k} END' for k in ks)} FROM {name}_walk WHERE {more})"""
            )
            self.ctes.append(f"{name} AS (SELECT docid, {high} AS pos FROM {name}_walk WHERE {more} AND {match})")
            return name
        if node.op == "SCORE":
            tf = self._add(f"SELECT docid, count(*) AS tf FROM {args[0]} GROUP BY docid")
            if self.model == "UnrankedBoolean":
                return self._add(f"SELECT docid, CAST(1.0 AS DOUBLE) AS score FROM {tf}")
            if self.model == "RankedBoolean":
                return self._add(f"SELECT docid, CAST(tf AS DOUBLE) AS score FROM {tf}")
            field = next(x.field for x in node.args[0].walk() if x.field)
            idf = f"ln(((SELECT n FROM nd) - (SELECT count(*) FROM {tf}) + 0.5) / ((SELECT count(*) FROM {tf}) + 0.5) + 1.0)"
            norm = f"{self.k1} * ({1 - self.b} + {self.b} * len(ws) / coalesce((SELECT average FROM st WHERE field = '{field}'), 1.0))"
            return self._add(f"SELECT x.docid, CAST({idf} * (tf * {self.k1 + 1}) / (tf + {norm}) AS DOUBLE) AS score FROM {tf} x JOIN w ON w.docid = x.docid AND w.field = '{field}'")
        weights = node.weights or [1.0] * len(args)
        rows = " UNION ALL ".join(f"SELECT docid, {w} * score AS score FROM {a}" for a, w in zip(args, weights))
        if node.op == "AND":
            return self._add(f"SELECT docid, min(score) AS score FROM ({rows}) GROUP BY docid HAVING count(*) = {len(args)}")
        return self._add(f"SELECT docid, {'max' if node.op == 'OR' else 'sum'}(score) AS score FROM ({rows}) GROUP BY docid")


def ranking(queries: dict[str, str], model: str = "BM25", k: int = 10, base: str | None = None, prefix: str = "doc-", after: str | None = None) -> str:
    """SQL of rankings (qid, docid, ext_id, score, rank); scores are rounded, and ranks go by the rounded ones."""
    sql, parts = Sql(model), []
    for qid, q in queries.items():
        tree = TREES[q]
        if tree is None:  # stopwords alone
            continue
        root = sql.visit(tree)
        parts.append(f"SELECT '{qid}' AS qid, docid, round(score, 6) AS score FROM {root}")
    ranked = f"""scored AS ({" UNION ALL ".join(parts)}),
    ranked AS (SELECT qid, docid, '{prefix}' || lpad(CAST(docid AS VARCHAR), 8, '0') AS ext_id, score,
      CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INTEGER) AS rank FROM scored)"""
    ctes = ", ".join([base or tables(), *sql.ctes, ranked])
    return f"WITH RECURSIVE {ctes} " + (after or f"SELECT qid, docid, ext_id, score, rank FROM ranked WHERE rank <= {k}")


def inverted_list(query: str, base: str | None = None) -> str:
    """SQL of (docid, tf, positions) of a position operator."""
    sql = Sql()
    root = sql.visit(TREES[query].args[0])
    ctes = ", ".join([base or tables(), *sql.ctes])
    return f"WITH RECURSIVE {ctes} SELECT docid, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM {root} GROUP BY docid"
