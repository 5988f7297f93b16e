"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Distinct vectors are dealt into shards of about SHARD by hash; each shard's graph is built in a task of its own. Nodes
are inserted in blocks that double up to BLOCK: each layer of a node (geometric, drawn from the shard's own seed) is
searched from the top down in the graph built so far, a beam of BREADTH gives the candidates (the block's own nodes
beside them), the diversity rule picks neighbours, which link back and are pruned to the degree by the same rule. A
graph is stored as flat neighbour arrays, one for each layer. All searches run side by side for a block of vectors.

Queries go to every shard in blocks, walk greedily down the layers and run a beam search on the lowest one; the best
of all shards are ranked by exact distances in double precision on the original vectors, ties by id.

Equal vectors are one node with its smallest ids, so thousands of copies neither fill a neighbour list nor cut a
graph apart; K + 1 distinct ids are enough for K answers beside the query itself.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no
part; vectors of another length are no candidates; rows that repeat an id and a vector count once; an id with
several vectors is one candidate and one query, as near as its nearest vector; with fewer candidates than K all
are returned; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import Stage, read
from rankforge.llm.embedding_dedup import sound

K, SHARD, DEGREE, BREADTH, BEAM, BLOCK, QUERY_BLOCK = 10, 8192, 16, 64, 128, 256, 2048


def diverse(between: np.ndarray, d: np.ndarray, degree: int) -> np.ndarray:
    """The usual rule for many nodes at once, as a mask of the candidates picked.

    d: distances of candidates to their node by row, nearest first, infinite for none; between: among candidates. A
    candidate nearer to a picked one than to the node waits; the first of those that wait fill up what is left.
    """
    rows, width = d.shape
    closest, picked, count = np.full((rows, width), np.inf), np.zeros((rows, width), bool), np.zeros(rows, int)
    for k in range(width):
        ok = (closest[:, k] > d[:, k]) & (count < degree)
        picked[ok, k] = True
        count += ok
        closest[ok] = np.minimum(closest[ok], between[ok, k])
    waiting = ~picked & np.isfinite(d)
    return picked | waiting & (np.cumsum(waiting, axis=1) <= (degree - count)[:, None])


class Graph:
    """Layers of flat neighbour arrays (nodes x degree, -1 for none); layer 0 holds all nodes, a higher one some."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None):
        # About their mean, single precision tells near vectors apart.
        self.mean = x.astype(np.float64).mean(0) if len(x) else np.zeros(x.shape[1])
        self.x = self._moved(x)
        self.norm = (self.x * self.x).sum(1)
        self.n = len(x)
        if layers is not None:
            self.links = [self._spread(nodes, links) for nodes, links in layers]
            self.entry = int(layers[-1][0][0]) if layers else -1
        else:
            self._build()

    def _moved(self, x: np.ndarray) -> np.ndarray:
        moved = x.astype(np.float64) - self.mean
        return moved.astype(np.float32) if np.abs(moved).max(initial=0) < 1e15 else moved

    def _spread(self, nodes: np.ndarray, links: np.ndarray) -> np.ndarray:
        out = np.full((self.n, links.shape[1]), -1, np.int32)
        out[nodes] = links
        return out

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(nodes, their neighbours as nodes) of each layer from the lowest on; the highest begins with the entry."""
        out = []
        for level, links in enumerate(self.links):
            nodes = np.flatnonzero(self.top >= level)
            if level == len(self.links) - 1:
                nodes = np.concatenate([[self.entry], nodes[nodes != self.entry]])
            out.append((nodes.astype(np.int32), links[nodes]))
        return out

    def _build(self) -> None:
        rng = np.random.default_rng(self.n)
        self.top = np.floor(-np.log(1 - rng.random(self.n)) / np.log(DEGREE)).astype(int)
        self.links = [np.full((self.n, 2 * DEGREE if level == 0 else DEGREE), -1, np.int32) for level in range(int(self.top.max(initial=-1)) + 1)]
        self.entry, at = (0 if self.n else -1), 1
        while at < self.n:
            block = np.arange(at, min(self.n, at + min(at, BLOCK)))
            self._insert(block)
            high = block[np.argmax(self.top[block])]
            if self.top[high] > self.top[self.entry]:
                self.entry = int(high)
            at = block[-1] + 1
        for level in range(len(self.links)):
            self._join(level)

    def _insert(self, block: np.ndarray) -> None:
        """Adds nodes to every layer of theirs; they find candidates in the graph as it is, and in their own block."""
        x, top = self.x[block], self.top[block]
        at = np.full(len(block), self.entry)
        for level in range(len(self.links) - 1, -1, -1):
            own = np.flatnonzero(top >= level)
            empty = level > self.top[self.entry]
            found, far = np.full((len(own), 0), -1), np.full((len(own), 0), np.inf)
            if not empty:
                passing = np.flatnonzero(top < level)
                if len(passing):
                    at[passing] = self.beam(level, x[passing], at[passing], 1)[0][:, 0]
                if len(own):
                    found, far = self.beam(level, x[own], at[own], BREADTH)
                    at[own] = found[:, 0]
            if not len(own):
                continue
            # The block's own nodes of this layer are candidates, too.
            mates = np.broadcast_to(block[own], (len(own), len(own)))
            near = self._between(x[own], x[own])
            near[np.arange(len(own)), np.arange(len(own))] = np.inf
            found, far = np.concatenate([found, mates], 1), np.concatenate([far, near], 1)
            order = np.lexsort((found, far))[:, :BREADTH]
            self._connect(level, block[own], np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1))

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0).astype(np.float64)

    def _pick(self, found: np.ndarray, far: np.ndarray, degree: int) -> np.ndarray:
        """Neighbours by the diversity rule among candidates (nearest first): nodes x degree, -1 for none."""
        out = np.full((len(found), degree), -1, np.int32)
        step = max(1, 4_000_000 // found.shape[1] ** 2)  # bounds what stands between candidates
        for lo in range(0, len(found), step):
            f, d = found[lo : lo + step], far[lo : lo + step]
            own = self.x[f]
            between = self.norm[f][:, :, None] + self.norm[f][:, None, :] - 2 * (own @ own.transpose(0, 2, 1))
            ok = diverse(between, d, degree)
            place = np.cumsum(ok, axis=1) - 1
            r, k = np.nonzero(ok)
            out[lo + r, place[r, k]] = f[r, k]
        return out

    def _connect(self, level: int, nodes: np.ndarray, found: np.ndarray, far: np.ndarray) -> None:
        """Sets the neighbours of new nodes, and links them back."""
        links, degree = self.links[level], self.links[level].shape[1]
        picked = self._pick(found, far, DEGREE)
        links[nodes, : picked.shape[1]] = picked
        k, j = np.nonzero(picked >= 0)
        to, back = picked[k, j], nodes[k]
        fresh = ~(links[to] == back[:, None]).any(1)  # two nodes of the block may have picked each other
        order = np.argsort(to[fresh], kind="stable")
        to, back = to[fresh][order], back[fresh][order]
        if not len(to):
            return
        some, first, n = np.unique(to, return_index=True, return_counts=True)
        # All neighbours of a node, old and new, side by side; those that are too many are picked anew.
        wide = np.full((len(some), degree + int(n.max())), -1, np.int32)
        wide[:, :degree] = links[some]
        wide[np.repeat(np.arange(len(some)), n), degree + np.arange(len(to)) - np.repeat(first, n)] = back
        d = self.norm[wide] + self.norm[some][:, None] - 2 * np.einsum("rd,rkd->rk", self.x[some], self.x[wide])
        d = np.where(wide < 0, np.inf, np.maximum(d, 0).astype(np.float64))
        order = np.lexsort((wide, d))
        wide, d = np.take_along_axis(wide, order, 1), np.take_along_axis(d, order, 1)
        over = np.isfinite(d).sum(1) > degree
        links[some[~over]] = wide[~over, :degree]
        if over.any():
            links[some[over]] = self._pick(wide[over], d[over], degree)

    def _join(self, level: int) -> None:
        """Every node of a layer within reach of the entry: each part beyond gets a link from its nearest reached node."""
        links, nodes = self.links[level], np.flatnonzero(self.top >= level)
        seen, front = np.zeros(self.n, bool), np.array([self.entry])
        while True:
            while len(front):
                seen[front] = True
                front = np.unique(links[front])
                front = front[(front >= 0) & ~seen[np.maximum(front, 0)]]
            lost, reached = nodes[~seen[nodes]][:512], nodes[seen[nodes]]
            if not len(lost):
                return
            d = self._between(self.x[lost], self.x[reached])
            k, j = np.unravel_index(np.argmin(d), d.shape)
            room = np.flatnonzero(links[reached[j]] < 0)
            if not len(room):
                links = self.links[level] = np.concatenate([links, np.full((self.n, 1), -1, np.int32)], axis=1)
                room = [links.shape[1] - 1]
            links[reached[j], room[0]] = lost[k]
            front = lost[k : k + 1]

    def beam(self, level: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam searches on one layer, side by side: the nodes found near each of q, nearest first (-1 for none), and squared distances.

        q is about the mean already. Each step opens every search's nearest node not opened yet, until a search has
        opened all its beam holds.
        """
        links, rows = self.links[level], np.arange(len(q))
        qq = (q * q).sum(1)
        seen = np.zeros((len(q), self.n + 1), bool)
        seen[:, -1] = True  # where no neighbour stands
        seen[rows, start] = True
        found, far, done = np.full((len(q), width), -1), np.full((len(q), width), np.inf), np.ones((len(q), width), bool)
        found[:, 0], done[:, 0] = start, False
        far[:, 0] = np.maximum(self.norm[start] + qq - 2 * (self.x[start] * q).sum(1), 0)
        live = rows
        while True:
            k = np.argmin(np.where(done[live], np.inf, far[live]), axis=1)
            going = ~done[live, k]
            live, k = live[going], k[going]
            if not len(live):
                break
            done[live, k] = True
            near = links[found[live, k]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            d = self.norm[near] + qq[live, None] - 2 * np.einsum("rd,rkd->rk", q[live], self.x[near])
            d = np.where(fresh, np.maximum(d, 0), np.inf)
            d = np.concatenate([far[live], d], 1)
            best = np.argpartition(d, width - 1, axis=1)[:, :width]
            far[live] = np.take_along_axis(d, best, 1)
            found[live] = np.take_along_axis(np.concatenate([found[live], near], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), best, 1)
        far[found < 0] = np.inf
        order = np.lexsort((found, far))
        found, far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), found, -1), far

    def search(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """For each of q about beam nodes near it, nearest first; -1 for none."""
        if not self.n:
            return np.empty((len(q), 0), int)
        out = []
        for lo in range(0, len(q), BLOCK):
            own = self._moved(q[lo : lo + BLOCK])
            at = np.full(len(own), self.entry)
            for level in range(len(self.links) - 1, 0, -1):
                at = self.beam(level, own, at, 1)[0][:, 0]
            out.append(self.beam(0, own, at, beam)[0])
        return np.concatenate(out)


def _matrix(lists, kind: type = np.float64) -> np.ndarray:
    """A column of vectors of one length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(lists), -1)


def nearest(x: np.ndarray, ids: list[list[int]], near: np.ndarray, q: np.ndarray, query_id: int, k: int) -> list[tuple[float, int]]:
    """The k nearest distinct ids but the query's own among the nodes near, with exact distances, nearest first."""
    near = near[near >= 0]
    least: dict[int, float] = {}
    for d, j in sorted(zip(np.sqrt(((x[near] - q) ** 2).sum(1)).tolist(), near.tolist())):
        for i in ids[j]:
            if i != query_id:
                least.setdefault(i, d)
    return sorted((d, i) for i, d in least.items())[:k]


def index(stage: Stage, rows: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """A graph for each shard of rows(vec_id, vector, dim): (dim, shard, vectors, ids, layers)."""
    # The smallest distinct ids of each distinct vector; the rank's limit is applied before its shuffle too.
    by = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.select("vec_id", "vector", "dim").distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)
    classes = stage.write(few.groupBy("vector", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    n_shards = stage.write(classes.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("n_shards")), "n_shards")
    total = n_shards.agg(F.sum("n_shards")).first()[0] or 1
    dealt = classes.join(n_shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("n_shards")).cast("int"))
    vector, ids = (classes.schema[c].dataType.simpleString() for c in ("vector", "ids"))

    def build(table):
        table = table.sort_by([("first", "ascending")])
        graph = Graph(_matrix(table.column("vector")))
        layers = [{"nodes": a.tobytes(), "links": b.tobytes(), "degree": b.shape[1]} for a, b in graph.layers()]
        kinds = pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary()), ("degree", pa.int32())]))
        lists = lambda c: pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type))
        return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "vectors": lists("vector"), "ids": lists("ids"), "layers": pa.array([layers], kinds)})

    schema = f"dim int, shard int, vectors array<{vector}>, ids array<{ids}>, layers array<struct<nodes:binary,links:binary,degree:int>>"
    dealt = dealt.select("dim", "shard", "vector", "ids", F.element_at("ids", 1).alias("first"))
    # A number of partitions of its own, which is not coalesced by bytes: what a task costs is the graph.
    dealt = dealt.repartition(2 * int(total), "dim", "shard")
    return stage.write(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "index")


def search(stage: Stage, built: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of queries(query_id, vector, dim) over all shards."""
    n_blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    shards = built.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = dealt.join(shards, "dim").select("dim", F.explode("shards").alias("shard"), "block", "query_id", "vector")
    copies = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(graphs, asked):
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        found = {n: [] for n in names}
        if graphs.num_rows and asked.num_rows:
            x = _matrix(graphs.column("vectors").combine_chunks().flatten())
            ids = graphs.column("ids")[0].as_py()
            layers = []
            for layer in graphs.column("layers")[0].as_py():
                layers.append((np.frombuffer(layer["nodes"], np.int32), np.frombuffer(layer["links"], np.int32).reshape(-1, layer["degree"])))
            q = _matrix(asked.column("vector"))
            for query_id, own, near in zip(asked.column("query_id").to_pylist(), q, Graph(x, layers).search(q, beam)):
                best = nearest(x, ids, near, own, query_id, k)
                found["query_id"] += [query_id] * len(best)
                found["score"] += [d for d, _ in best]
                found["vec_id"] += [i for _, i in best]
        return pa.table({n: pa.array(v, names[n]) for n, v in found.items()})

    key = ("dim", "shard", "block")
    n_tasks = max(1, 2 * built.count() * n_blocks)
    copies, asked = (t.repartition(n_tasks, *key) for t in (copies, asked))
    each = copies.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col(vector_col)
    return vectors.where(sound(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim"))


def neighbours(vectors: DataFrame, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the K nearest of each row whose vec_id is divisible by every."""
    rows = prepared(vectors)
    stage = Stage(vectors.sparkSession)
    queries = rows.where(F.col("vec_id") % every == 0).distinct().withColumnRenamed("vec_id", "query_id")
    return search(stage, index(stage, rows), queries)


def op10_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"))
