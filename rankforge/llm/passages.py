"""Substring dedup: fuzzy passages that repeat across documents, by collinear chaining.

Words are hashed, and of each WINDOW neighbouring shingles of SHINGLE words the one with the smallest hash is a seed, so
two documents that share WINDOW + SHINGLE - 1 words in a row share a seed. A seed that several documents hold
matches each of its places with its place in the first and in the last of them, so a passage in a third of all
documents costs two rows for each place, not one for each pair.

Neighbouring seeds of a document that are each held by several documents are a key together: all who hold such a pair meet
the first document that holds it, whatever holds one of its seeds alone.

Whether that place is in the same document as for the neighbouring seed depends on what else holds them. So where all
seeds of a stretch are held by several documents, its runs of LEAST_WORDS words are keys, too (of THIN neighbouring
runs the one with the smallest hash): who holds a run shares a whole passage with the first document that holds it. Two documents with LEAST_WORDS + THIN - 1 words in a row alike so always have a passage with one
document of the class in common, however often pieces of it stand elsewhere.

The matches of two documents are chained: in order in both, with costs for gaps, the best chain up to each match being
the maximum of a prefix in a Fenwick tree. Chains are aligned: words of a segment are compared, gaps are aligned by
their longest common subsequence, ends are extended. What is long and similar enough is a passage.

Documents are keyed by a number of their own, so null and repeated ids don't matter. What many documents meet, the text
of a first one, is dealt out by up to SALTS numbers, each for about MEET of them.

Defined results: null, empty and short texts have no passages; of repeated rows all but one have one with the first; an
empty table gives an empty result; only the id and the text are read, so extra columns don't matter. Passages that
repeat only within one document are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Stage, read

SHINGLE, WINDOW, LEAST_WORDS, THIN, SIMILARITY, SALTS, MEET = 5, 12, 50, 4, 0.8, 256, 8
#: Cost of a word in a gap, on either side; a matched word counts 1.
GAP_COST = 0.1
#: Extension of a passage's ends: cost of a word that differs, and how far below its best it may fall.
DIFFERS, DROP = 2, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed in lots of about so many bytes, since most are too short for numpy.
LOT = 1 << 16


#: An odd base, and its inverse modulo 2^64; their powers, as far as they were needed.
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    while len(_POWERS[0]) < n:
        size = len(_POWERS[0])
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * np.uint64(pow(base, size, 1 << 64))])
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words (A-Z lower-cased, split at ASCII white space)."""
    ((_, h, _),) = hashed([(text or "").encode()])
    return h


def hashed(texts: list[bytes], most: int = LOT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lots of texts that follow one another: the first one's number, the hashes of all their words, and where each text's begin, with the end."""
    first = size = 0
    for k, text in enumerate(texts, 1):
        size += len(text) + 1
        if size > most or k == len(texts):
            lot = texts[first:k]
            starts, h = _hashed(b" ".join(lot))
            yield first, h, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in lot)]))
            first, size = k, 0


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes: polynomials of their bytes, mixed.

    With running sums of bytes over powers of the base, a word's polynomial is one difference, whatever its length and its place.
    """
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    # Less 9, white space is 0 to 4 or 23.
    inside = (b != 32) & (b - np.uint8(9) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    sums = np.zeros(len(b) - 1, np.uint64)
    terms = b[1:-1].astype(np.uint64)
    terms += np.uint64(1)
    terms *= down[: len(terms)]
    np.cumsum(terms, out=sums[1:])
    return starts, _mixed((sums[ends] - sums[starts]) * up[ends], (ends - starts).astype(np.uint64))


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's number and the hashes of its words."""
    for first, h, bounds in hashed(column.cast(pa.binary()).to_pylist()):
        ends = bounds.tolist()
        yield from ((first + k, h[i:j]) for k, (i, j) in enumerate(zip(ends, ends[1:])))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of that many words, put together from runs of powers of two."""
    parts, at, length = [], 0, 1
    with np.errstate(over="ignore"):
        while length <= size:
            if size & length:
                parts.append((h, at))
                at += length
            if 2 * length <= size:
                h = _mixed(h[:-length], h[length:])
            length *= 2
        n = at and max(0, len(parts[-1][0]) - parts[-1][1])
        out = np.zeros(n, np.uint64)
        for own, start in parts:
            out = _mixed(out, own[start : start + n])
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = b + _MIX
    out ^= a
    out *= _MIX
    out ^= out >> np.uint64(29)
    low = out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= low
    return out


def extremes(keys: np.ndarray, window: int, of=np.minimum) -> np.ndarray:
    """The smallest (or largest) key of each window of neighbouring keys; of all, if there are fewer."""
    window, done = min(window, len(keys)), 1
    while done < window:
        step = min(done, window - done)
        keys = of(keys[:-step], keys[step:])
        done += step
    return keys


def lowest(keys: np.ndarray, window: int) -> np.ndarray:
    """Which keys are the smallest one of some window, as a mask; equal ones are so together."""
    if not len(keys):
        return np.zeros(0, bool)
    window = min(window, len(keys))
    low, none = extremes(keys, window), np.zeros(window - 1, np.uint64)
    return extremes(np.concatenate([none, low, none]), window, np.maximum) == keys


def chosen(keys: np.ndarray, window: int, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the smallest keys of windows stand, and in which text: keys of runs of size words of texts whose words begin at bounds."""
    lengths, width = np.diff(bounds), size + window - 1
    of, low = np.repeat(np.arange(len(lengths)), lengths), np.zeros(len(keys), bool)
    if len(of) >= width:
        # Windows that lie in one text.
        least = np.where(of[width - 1 :] == of[: len(of) - width + 1], extremes(keys, window), np.uint64(0))
        none = np.zeros(window - 1, np.uint64)
        low = extremes(np.concatenate([none, least, none]), window, np.maximum) == keys
    for k in np.flatnonzero(lengths < width).tolist():
        begin, end = bounds[k], bounds[k + 1]
        low[begin:end] = False
        if end - begin >= size:
            low[begin : end - size + 1] = lowest(keys[begin : end - size + 1], window)
    at = np.flatnonzero(low)
    return at, of[at]


def seeds(h: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the seeds and their hashes, in one text or in texts whose words begin at bounds."""
    keys = runs(h, SHINGLE)
    at, _ = chosen(keys, WINDOW, np.array([0, len(h)]) if bounds is None else bounds, SHINGLE)
    return at, keys[at].view(np.int64)


def shared_runs(h: np.ndarray, shared: np.ndarray, least: int = LEAST_WORDS, small: np.ndarray | None = None, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen runs of least words all of whose seeds are among those at the places shared; small: runs(h, SHINGLE), if known."""
    bounds = np.array([0, len(h)]) if bounds is None else bounds
    keys, small = runs(h, least), runs(h, SHINGLE) if small is None else small
    at, of = chosen(keys, THIN, bounds, least)
    there = np.zeros(len(small), bool)
    there[shared] = True
    # Windows whose seed is shared: their smallest key stands at such a place, too.
    ok = extremes(np.where(there, small, ~np.uint64(0)), WINDOW) == extremes(small, WINDOW)
    # A run holds the windows that begin at its first word and after, as far as they end in it.
    inside = max(1, least - SHINGLE - WINDOW + 2)
    bad = np.concatenate([[0], np.cumsum(~ok)])
    at = at[at + inside < len(bad)]
    at = at[bad[at + inside] == bad[at]]
    return at, keys[at].view(np.int64)


def neighbours(h: np.ndarray, shared: np.ndarray, least: int = LEAST_WORDS, small: np.ndarray | None = None, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (the first one's times 2^32, and the second one's) and hashes of neighbouring seeds among those at the places shared, at most least words apart."""
    shared, small = np.sort(shared), runs(h, SHINGLE) if small is None else small
    near = np.diff(shared) <= least
    if bounds is not None:
        of = np.searchsorted(bounds, shared, "right")
        near &= of[1:] == of[:-1]
    near = np.flatnonzero(near)
    return shared[near] << 32 | shared[near + 1], _mixed(small[shared[near]], small[shared[near + 1]]).view(np.int64)


def numbered(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(row, id, text) of the texts that may have that many words."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.where(F.length("text") >= 2 * least - 1)


def places(texts: DataFrame, least: int, more: bool = False) -> DataFrame:
    """(row, key, at, back, ahead): the seeds of texts(row, text), and how far the text's first and last place of the same key are from each.

    more: of texts(row, text, ats) what neighbours (keys are even) and shared_runs (odd, at times 2^32) find.
    """
    # Only texts as long as a window of seeds can be chosen from together.
    most = LOT if least >= SHINGLE + WINDOW - 1 else 0

    def run(batches):
        for b in batches:
            if more:
                lists = b.column(2)
                ats, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            for first, h, bounds in hashed(b.column(1).cast(pa.binary()).to_pylist(), most):
                lengths = np.diff(bounds)
                if lengths.max() < least:
                    continue
                if more:
                    shared = ats[ends[first] : ends[first + len(lengths)]] + np.repeat(bounds[:-1], np.diff(ends[first : first + len(lengths) + 1]))
                    small = runs(h, SHINGLE)
                    (at, key), (run_at, run_key) = (f(h, shared, least, small, bounds) for f in (neighbours, shared_runs))
                    word, key = np.concatenate([at >> 32, run_at]), np.concatenate([key & ~1, run_key | 1])
                    second = np.concatenate([at & (1 << 32) - 1, np.full(len(run_at), -1)])
                else:
                    word, key = seeds(h, bounds)
                of = np.searchsorted(bounds, word, "right") - 1
                at = word - bounds[of]
                if more:
                    at = at << 32 | np.where(second < 0, 0, second - bounds[of])
                enough = lengths[of] >= least
                of, key, at = of[enough], key[enough], at[enough]
                order = np.lexsort((at, key, of))
                of, key, at = of[order], key[order], at[order]
                heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(at) else np.zeros(0, int)
                sizes = np.diff(np.append(heads, len(at)))
                back, ahead = at - np.repeat(at[heads], sizes), np.repeat(at[heads + sizes - 1], sizes) - at
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + of, pa.int64())), *(pa.array(x, pa.int64()) for x in (key, at, back, ahead))], names=["row", "key", "at", "back", "ahead"])

    return texts.select("row", "text", *["ats"] * more).mapInArrow(run, "row long, key long, at long, back long, ahead long")


def met(stage: Stage, found: DataFrame) -> DataFrame:
    """(row, at, kind, low, low_at, high, high_at) of places whose key is held by several documents: its places in the first and the last one; kind: the key's last bit."""
    # Numbers of 64 bits are aggregated by hash, structs would be sorted. All places of a document say the same, so ties don't matter.
    low_at, high_at = F.min_by(F.col("at") - F.col("back"), "row").alias("low_at"), F.max_by(F.col("at") + F.col("ahead"), "row").alias("high_at")
    shared = found.groupBy("key").agg(F.min("row").alias("low"), low_at, F.max("row").alias("high"), high_at).where("low <> high")
    shared = stage.write(shared, "shared")
    # A key stands once among the shared ones: they are hashed, the places need no order.
    one = found.select("row", "key", "at").join(shared.hint("shuffle_hash"), "key")
    out = stage.write(one.select("row", "at", F.col("key").bitwiseAND(1).alias("kind"), "low", "low_at", "high", "high_at"), "met")
    stage.drop(shared)
    return out


def stars(met: DataFrame, last: bool) -> DataFrame:
    """(a, b, p, q): every place matched with the first one (and with the last one, too), except in its own document; a before b.

    What else the first document holds is matched with the last one.
    """
    own, at_last = F.col("row") == F.col("low"), F.col("row") == F.col("high")
    if last:
        low, high = (F.struct(F.col(x).alias("row"), F.col(f"{x}_at").alias("at")) for x in ("low", "high"))
        pair = met.select("row", "at", F.explode(F.when(own, F.array(high)).when(at_last, F.array(low)).otherwise(F.array(low, high))).alias("other"))
        pair = pair.select("row", "at", F.col("other.row").alias("other"), F.col("other.at").alias("other_at"))
    else:
        pair = met.where(~own | (F.col("at") != F.col("low_at")))
        pair = pair.select("row", "at", F.when(own, F.col("high")).otherwise(F.col("low")).alias("other"), F.when(own, F.col("high_at")).otherwise(F.col("low_at")).alias("other_at"))
    first = F.col("row") < F.col("other")
    return pair.select(
        F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"),
        F.when(first, F.col("at")).otherwise(F.col("other_at")).alias("p"), F.when(first, F.col("other_at")).otherwise(F.col("at")).alias("q"),
    )


def matches(seed_places: DataFrame, more_places: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(a, b, pairs): for two documents that share two seeds or a run, their places with the words alike, the one in a times 2^32 and the one in b; a before b.

    Of runs of least words all bits are the other way.
    """
    both = lambda p, q: F.shiftleft(p, 32).bitwiseOR(q)
    upper, lower = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND((1 << 32) - 1)
    by_seed = stars(seed_places, True).select("a", "b", both(F.col("p"), F.col("q")).alias("m"))
    by_pair = stars(more_places.where("kind = 0"), False)
    by_pair = by_pair.select("a", "b", F.explode(F.array(both(upper("p"), upper("q")), both(lower("p"), lower("q")))).alias("m"))
    # Runs on one diagonal within as many words as they have: what lies between the first and the last of them is covered by both.
    run = stars(more_places.where("kind = 1"), False).select("a", "b", upper("p").alias("p"), upper("q").alias("q"))
    near = [F.col("a"), F.col("b"), (F.col("q") - F.col("p")).alias("shift"), F.floor(F.col("p") / least).alias("part")]
    ends = run.groupBy(*near).agg(F.min("p").alias("first"), F.max("p").alias("last"))
    by_run = ends.select("a", "b", F.explode(F.array("first", "last")).alias("p"), "shift").select("a", "b", F.bitwise_not(both(F.col("p"), F.col("p") + F.col("shift"))).alias("m"))
    pairs = by_seed.union(by_pair).union(by_run).groupBy("a", "b").agg(F.collect_set("m").alias("pairs"))
    return pairs.where((F.size("pairs") > 1) | F.exists("pairs", lambda m: m < 0) | F.lit(least <= SHINGLE))


class Fenwick:
    """Maximum of prefixes, with the number of the element that has it."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, k: int, value: float, number: int) -> None:
        k += 1
        while k < len(self.best):
            if value > self.best[k][0]:
                self.best[k] = (value, number)
            k += k & -k

    def upto(self, k: int) -> tuple[float, int]:
        """Over elements put at positions below k."""
        found = (-np.inf, -1)
        while k > 0:
            if self.best[k] > found:
                found = self.best[k]
            k -= k & -k
        return found


def segments(of: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray, reach: int = 2 * WINDOW - SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Matches of n words on one diagonal that follow closely, as rows (start in a, start in b, length), and what pair of documents, by number, each is of."""
    order = np.lexsort((p, p - q, of))
    of, p, q, n = of[order], p[order], q[order], n[order]
    apart = np.concatenate([[False], (np.diff(p - q) != 0) | (of[1:] != of[:-1])])
    # The furthest end so far on each diagonal: diagonals follow one another far apart.
    line = np.cumsum(apart) * (int((p + n).max()) + 1)
    ends = np.maximum.accumulate(p + n + line) - line
    new = np.ones(len(p), bool)
    new[1:] = apart[1:] | (p[1:] - ends[:-1] > reach)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(p)) - 1
    return np.stack([p[heads], q[heads], ends[tails] - p[heads]], 1), of[heads]


def chains(found: np.ndarray, gap_cost: float = GAP_COST) -> list[np.ndarray]:
    """Segments in chains, the best first; each segment is in one chain."""
    if len(found) == 1:
        return [found]
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    p, q, n = found.T.tolist()
    ends_q = sorted({y + k for y, k in zip(q, n)})
    rank = {e: i for i, e in enumerate(ends_q)}
    below = np.searchsorted(ends_q, q, "right").tolist()
    by_end = sorted(range(len(p)), key=lambda k: p[k] + n[k])
    tree, score, back, done = Fenwick(len(ends_q)), [0.0] * len(p), [-1] * len(p), 0
    for k in range(len(p)):
        # All segments that end where this one begins, or before, may precede it.
        while done < len(by_end) and p[by_end[done]] + n[by_end[done]] <= p[k]:
            i = by_end[done]
            tree.put(rank[q[i] + n[i]], score[i] + gap_cost * (p[i] + q[i] + 2 * n[i]), i)
            done += 1
        best, i = tree.upto(below[k])
        gain = best - gap_cost * (p[k] + q[k])
        score[k] = n[k] + max(gain, 0.0)
        back[k] = i if gain > 0 else -1
    used, out = [False] * len(p), []
    for k in sorted(range(len(p)), key=lambda k: -score[k]):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = back[k]
        if chain:
            out.append(found[chain[::-1]])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not len(a) or not len(b):
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & where.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two sequences, both read from their first word, go on alike: words, and how many of them are equal."""
    best = taken = equal = score = hits = 0
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    lo, hi = 0, 8  # most ends go on for a few words only
    while lo < n:
        for k, same in enumerate((a[lo:hi] == b[lo:hi]).tolist(), lo):
            score += 1 if same else -DIFFERS
            hits += same
            if score > best:
                best, taken, equal = score, k + 1, hits
            elif score < best - DROP:
                return taken, equal
        lo, hi = hi, hi + 64
    return taken, equal


def align(chain: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Passages (start and end in a, start and end in b, similarity) of a chain; one that is too unlike is cut at its widest gap."""
    gaps, chain = [], chain.tolist()
    for x, y in zip(chain[:-1], chain[1:]):
        gaps.append((x[0] + x[2], y[0], x[1] + x[2], y[1]))
    inside = [np.count_nonzero(a[p : p + n] == b[q : q + n]) for p, q, n in chain]
    between = [common(a[i:j], b[k:m]) for i, j, k, m in gaps]
    todo, out = [(0, len(chain))], []
    while todo:
        lo, hi = todo.pop()
        p, q, _ = chain[lo]
        p2, q2, n = chain[hi - 1]
        p2, q2 = p2 + n, q2 + n
        left, l_equal = extend(a[:p][::-1], b[:q][::-1])
        right, r_equal = extend(a[p2:], b[q2:])
        p, q, p2, q2 = p - left, q - left, p2 + right, q2 + right
        equal = sum(inside[lo:hi]) + sum(between[lo : hi - 1]) + l_equal + r_equal
        like = equal / max(p2 - p, q2 - q)
        if like >= similarity:
            if min(p2 - p, q2 - q) >= least:
                out.append((p, p2, q, q2, like))
        elif hi - lo > 1:
            cut = max(range(lo, hi - 1), key=lambda k: (gaps[k][1] - gaps[k][0]) + (gaps[k][3] - gaps[k][2]) - 2 * between[k])
            todo += [(lo, cut + 1), (cut + 1, hi)]
    return out


def located(found: list[np.ndarray], a: np.ndarray, b: np.ndarray, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Passages of the chains of two documents, without those that lie inside another one in both.

    A chain whose words are in passages already, in both documents, adds none: a text that repeats itself matches another
    one on as many diagonals as it has words.
    """
    there, out = (np.zeros(len(a), bool), np.zeros(len(b), bool)), []
    rows = [c.tolist() for c in found]
    for k in sorted(range(len(rows)), key=lambda k: (-sum(x[2] for x in rows[k]), rows[k][0][0] + rows[k][0][1])):
        c, (p, q, _), (p2, q2, n) = found[k], rows[k][0], rows[k][-1]
        p2, q2 = p2 + n, q2 + n
        if there[0][p:p2].all() and there[1][q:q2].all():
            continue
        for x in align(c, a, b, least, similarity):
            there[0][x[0] : x[1]] = there[1][x[2] : x[3]] = True
            out.append(x)
    kept: list[tuple[int, int, int, int, float]] = []
    for x in sorted(out, key=lambda x: (x[0] - x[1], x)):
        if not any(y[0] <= x[0] and x[1] <= y[1] and y[2] <= x[2] and x[3] <= y[3] for y in kept):
            kept.append(x)
    return sorted(kept)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start, end, other_id, other_start, other_end, similarity), positions in words, ends exclusive."""
    stage = Stage(docs.sparkSession)
    texts = stage.write(numbered(docs, id_col, text_col, least), "numbered")
    own = stage.write(places(texts, least), "places")
    seed_places = met(stage, own)
    stage.drop(own)
    shared = seed_places.groupBy("row").agg(F.collect_list("at").alias("ats")).where(F.size("ats") > 1)
    few = stage.write(texts.join(shared, "row"), "texts")
    stage.drop(texts)
    own = stage.write(places(few, least, more=True), "places")
    more_places = met(stage, own)
    stage.drop(own)

    def chain(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists, of, chained = b.column(2), [], []
            m = lists.flatten().to_numpy()
            run = m < 0
            m = np.where(run, ~m, m)
            number = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            found, number = segments(number, m >> 32, m & (1 << 32) - 1, np.where(run, least, SHINGLE))
            ends = np.searchsorted(number, np.arange(b.num_rows + 1)).tolist()
            for k, (i, j) in enumerate(zip(ends, ends[1:])):
                for c in chains(found[i:j]):
                    # Between seeds and beyond the ends a passage goes on unseen by less than a window and a shingle.
                    if (c[-1, 0] + c[-1, 2] - c[0, 0]) + 2 * (WINDOW + SHINGLE) >= least * similarity:
                        of.append(k)
                        chained.append(c.ravel())
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(chained, pa.list_(pa.int32()))], names=["a", "b", "chain"])

    found = matches(seed_places, more_places, least).mapInArrow(chain, "a long, b long, chain array<int>")
    unsalted = stage.write(found.groupBy("a", "b").agg(F.collect_list("chain").alias("chains")), "chains")
    stage.drop(seed_places, more_places)
    salts = unsalted.groupBy("a").agg(F.least(F.ceil(F.count("*") / MEET), F.lit(SALTS)).alias("salts"))
    found = stage.write(unsalted.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts")).drop("salts"), "salted")
    stage.drop(unsalted)
    side = lambda s: few.select(F.col("row").alias(s), F.col("id").alias(f"{s}_id"), F.col("text").alias(f"{s}_text"))
    # A first document may meet a third of all others: its text goes to each salt that needs it.
    first = found.select("a", "salt").distinct().join(side("a"), "a")
    last = found.join(side("b"), "b")
    both = last.join(first, ["a", "salt"]).select("a", "a_id", "b_id", "chains", "a_text", "b_text")
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            rows, at = [], []
            of, ends = batch.column(3).offsets.to_pylist(), batch.column(3).values.offsets.to_pylist()
            flat = batch.column(3).values.values.to_numpy().astype(np.int64)
            # Rows of one first document come one after another.
            now = batch.column(0).to_numpy()
            new = np.concatenate([[True], now[1:] != now[:-1]])[: len(now)]
            firsts = [h for _, h in texts_of(batch.column(4).filter(pa.array(new)))]
            which = (np.cumsum(new) - 1).tolist()
            for k, y in texts_of(batch.column(5)):
                x = firsts[which[k]]
                for f in located([flat[ends[c] : ends[c + 1]].reshape(-1, 3) for c in range(of[k], of[k + 1])], x, y, least, similarity):
                    rows.append(f)
                    at.append(k)
            ids = [batch.column(c).take(pa.array(at, pa.int64())) for c in (1, 2)]
            p, p2, q, q2, like = zip(*rows) if rows else ((),) * 5
            ints = [pa.array(v, pa.int64()) for v in (q, q2, p, p2)]
            yield pa.RecordBatch.from_arrays([ids[1], *ints[:2], ids[0], *ints[2:], pa.array(like, pa.float64())], names=["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"])

    out = stage.write(both.mapInArrow(measure, f"doc_id {kind}, start long, end long, other_id {kind}, other_start long, other_end long, similarity double"), "passages")
    stage.drop(few, found)
    return out


def op6_passages(spark, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))
