"""Compilation of a batch of query trees into one DataFrame plan.

All queries' nodes are numbered together and evaluated from the roots down: one grouping for each depth of score
operators, one join with document frequencies, one grouping for each level of position operators, and a scan for the
terms that each of these consumes. The plan grows with the depth of the deepest tree, not with the number of queries. What
is broadcast are the nodes of the queries, never anything of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions import positions
from rankforge.plans.tree import Node
from rankforge.sources.index import FILTER_TERMS, Index

#: Up to so many nodes (a few MB) are broadcast.
BROADCAST_NODES = 100_000


@dataclass
class _Entry:
    id: int
    node: Node
    parent: int  # -1 at a root
    place: int
    weight: float
    level: int  # 0 at a term
    qid: str


def number(trees: dict[str, Node]) -> list[_Entry]:
    out: list[_Entry] = []

    def visit(node: Node, qid: str) -> _Entry:
        below = [visit(a, qid) for a in node.args]
        entry = _Entry(len(out), node, -1, 0, 1.0, 1 + max((e.level for e in below), default=-1), qid)
        out.append(entry)
        for place, e in enumerate(below):
            e.parent, e.place, e.weight = entry.id, place, node.weights[place] if node.weights else 1.0
        return entry

    for qid, tree in trees.items():
        visit(tree, qid)
    return out


class _Batch:
    """The nodes of a batch and the rows that they give.

    Rows are asked for by the nodes that consume them, so each scan reads the terms of its consumers only, and the plan
    holds every posting list once for its score (and once, without positions, for its document frequency).
    """

    def __init__(self, index: Index, trees: dict[str, Node]):
        self.entries = number(trees)
        self.index = index.of_terms((e.node.field, e.node.term) for e in self.entries if e.node.op == "TERM")
        # Of chains that only a SCORE sees, the number is enough; it needs ascending lists, so not chains of chains.
        self.counted = {e.id for e in self.entries if e.node.op == "NEAR" and self._parent_op(e) == "SCORE" and all(a.op != "NEAR" for a in e.node.args)}
        self._made: dict[int, DataFrame] = {}

    def _parent_op(self, e: _Entry) -> str | None:
        return self.entries[e.parent].node.op if e.parent >= 0 else None

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        """Something of the queries' nodes; broadcast unless the batch is a very large one."""
        made = self.index.docs.sparkSession.createDataFrame(rows, schema)
        return F.broadcast(made) if len(rows) <= BROADCAST_NODES else made

    @staticmethod
    def _small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_NODES else df

    @staticmethod
    def _of_terms(rows: DataFrame, terms: list[_Entry]) -> DataFrame:
        """rows(field, term, ...) cut down by filters that reach the files."""
        wanted = sorted({e.node.term for e in terms})
        rows = rows.where(F.col("field").isin(sorted({e.node.field for e in terms})))
        return rows.where(F.col("term").isin(wanted)) if len(wanted) <= FILTER_TERMS else rows

    def leaves(self, terms: list[_Entry], with_positions: bool) -> DataFrame:
        """(node, docid, tf, len_all, positions) of terms, by one scan."""
        found = self._of_terms(self.index.postings, terms)
        nodes = self.table([(e.node.field, e.node.term, e.id) for e in terms], "field string, term string, node int")
        positions_ = F.col("positions") if with_positions else F.lit(None).cast("array<int>").alias("positions")
        return found.join(nodes, ["field", "term"]).select("node", "docid", F.col("tf").cast("long").alias("tf"), "len_all", positions_)

    def lists(self, wanted: list[_Entry], with_positions: bool = True) -> DataFrame:
        """Postings of position operators, terms or not."""
        parts = []
        terms = [e for e in wanted if e.node.op == "TERM"]
        if terms:
            parts.append(self.leaves(terms, with_positions))
        levels = sorted({e.level for e in wanted if e.node.op != "TERM"})
        for level in levels:
            made = self._level(level)
            if sum(e.node.positional and e.level == level for e in self.entries) > sum(e.level == level for e in wanted if e.node.op != "TERM"):
                made = made.where(F.col("node").isin([e.id for e in wanted if e.level == level]))
            parts.append(made)
        return reduce(DataFrame.unionByName, parts)

    def _level(self, level: int) -> DataFrame:
        """Postings of all position operators of one level."""
        if level in self._made:
            return self._made[level]
        parents = [e for e in self.entries if e.node.positional and e.level == level]
        ids = {e.id for e in parents}
        below = [e for e in self.entries if e.parent in ids]
        edges = [(e.id, e.parent, e.place, len(self.entries[e.parent].node.args), self.entries[e.parent].node.op, self.entries[e.parent].node.n or 0) for e in below]
        children = self.lists(below).join(self.table(edges, "node int, parent int, place int, n_args int, op string, n int"), "node")
        grouped = children.groupBy("parent", "docid", "n_args", "op", "n").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "positions"))), lambda x: x["positions"]).alias("lists"), F.max("len_all").alias("len_all")
        )
        grouped = grouped.where((F.col("op") == "SYN") | (F.size("lists") == F.col("n_args")))
        lists, n = F.col("lists"), F.col("n")
        counted = sorted(self.counted & ids)
        only_count = F.col("parent").isin(counted) if counted else F.lit(False)
        ends = F.when(F.col("op") == "SYN", positions.union(lists)).when(F.col("op") == "WINDOW", positions.window_ends(lists, n))
        ends = ends.when(~only_count, positions.chain_ends(lists, n)).otherwise(F.array().cast("array<int>"))
        count = F.when((F.col("op") == "NEAR") & only_count, positions.chain_count(lists, n)).otherwise(F.size("positions")).cast("long")
        out = grouped.withColumn("positions", ends).withColumn("tf", count)
        self._made[level] = out.where("tf > 0").select(F.col("parent").alias("node"), "docid", "tf", "len_all", "positions")
        return self._made[level]

    def scored(self, wanted: list[_Entry], model) -> DataFrame:
        """(node, docid, score) of SCORE nodes."""
        below = {e.parent: e for e in self.entries if self._parent_op(e) == "SCORE"}
        own = [below[e.id] for e in wanted]
        rows = self.lists(own, with_positions=False)
        nodes = [(e.id, e.parent, self.index.stats(e.node.field).average if model.uses_statistics else 1.0) for e in own]
        rows = rows.join(self.table(nodes, "node int, parent int, average double"), "node")
        if model.uses_statistics:
            # A row for each node at most. An operator's frequency is counted; a term's stands in the index, if it is a written one.
            counted = [e for e in own if e.node.op != "TERM" or self.index.terms is None]
            known = [e for e in own if e.node.op == "TERM" and self.index.terms is not None]
            parts = []
            if counted:
                some = rows if len(counted) == len(own) else rows.where(F.col("node").isin([e.id for e in counted]))
                parts.append(some.groupBy("node").agg(F.count("*").alias("df")))
            if known:
                nodes = self.table([(e.node.field, e.node.term, e.id) for e in known], "field string, term string, node int")
                parts.append(self._of_terms(self.index.terms, known).join(nodes, ["field", "term"]).select("node", "df"))
            rows, num_docs = rows.join(self._small(reduce(DataFrame.unionByName, parts), len(own)), "node"), self.index.num_docs
        else:
            rows, num_docs = rows.withColumn("df", F.lit(0)), 0
        score = model.score(F.col("tf"), F.col("df"), F.col("len_all"), F.col("average"), num_docs)
        return rows.select(F.col("parent").alias("node"), "docid", score.alias("score"))

    def combined(self, wanted: list[_Entry], model) -> DataFrame:
        """(node, docid, score) of score operators of any kind."""
        parts = []
        plain = [e for e in wanted if e.node.op == "SCORE"]
        if plain:
            parts.append(self.scored(plain, model))
        rest = [e for e in wanted if e.node.op != "SCORE"]
        if rest:
            ids = {e.id for e in rest}
            below = [e for e in self.entries if e.parent in ids]
            edges = [(e.id, e.parent, e.place, e.weight if self._parent_op(e) == "WSUM" else 1.0, len(self.entries[e.parent].node.args), self._parent_op(e)) for e in below]
            children = self.combined(below, model).join(self.table(edges, "node int, parent int, place int, weight double, n_args int, op string"), "node")
            grouped = children.groupBy("parent", "docid", "n_args", "op").agg(
                F.count("*").alias("met"), F.min("score").alias("low"), F.max("score").alias("high"), F.collect_list(F.struct("place", (F.col("weight") * F.col("score")).alias("s"))).alias("parts")
            )
            # Sums run in the order of arguments, so they don't depend on the order in which rows arrive.
            total = F.aggregate(F.array_sort("parts"), F.lit(0.0), lambda a, x: a + x["s"])
            value = F.when(F.col("op") == "AND", F.col("low")).when(F.col("op") == "OR", F.col("high")).otherwise(total)
            parts.append(grouped.where((F.col("op") != "AND") | (F.col("met") == F.col("n_args"))).select(F.col("parent").alias("node"), "docid", value.alias("score")))
        return reduce(DataFrame.unionByName, parts)

    def by_query(self, rows: DataFrame) -> DataFrame:
        roots = [(e.id, e.qid) for e in self.entries if e.parent < 0]
        return rows.join(self.table(roots, "node int, qid string"), "node").drop("node")

    @property
    def roots(self) -> list[_Entry]:
        return [e for e in self.entries if e.parent < 0]


def postings_of(index: Index, trees: dict[str, Node]) -> DataFrame:
    """(qid, docid, tf, len_all, positions) of position operators: the inverted lists of trees without scores."""
    batch = _Batch(index, {qid: t.args[0] if t.op == "SCORE" else t for qid, t in trees.items()})
    return batch.by_query(batch.lists(batch.roots))


def scores(index: Index, trees: dict[str, Node], model) -> DataFrame:
    """(qid, docid, score) of every document that matches its query; trees have a score operator on top."""
    if not trees:
        return index.docs.sparkSession.createDataFrame([], "qid string, docid long, score double")
    batch = _Batch(index, trees)
    return batch.by_query(batch.combined(batch.roots, model)).select("qid", "docid", "score")
