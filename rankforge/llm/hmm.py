"""Language-model scoring with a hidden Markov model.

Tokens are a text's words (A-Z lower-cased, split at ASCII white space) and one end. Token counts over all training
documents give the base model. The hidden Markov model emits SYMBOLS symbols: the end, the most frequent words, and
one symbol for all other words; which other word it is follows from its count. Baum-Welch runs over all training
tokens, whole texts side by side (those of over LONG tokens wait for others of their task): every task sends its
expected counts as rows by symbol, they are summed in Spark, and the driver gets SYMBOLS x STATES sums, whatever the
input. Scores are exact: the scaled forward recursion over the whole text.

Up to HEAD of the most frequent words of at most LONGEST bytes are looked up in the tasks (that bounds the table);
all others are joined with the counts, each distinct word of a document once.

Defined results: a null or empty text is one end; repeated rows are scored one by one (and learned from as often); a
null id counts as the empty text for the split; with nothing to learn from, all symbols are equally likely; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Stage, read

STATES, SYMBOLS, HEAD, LONGEST, LONG, ROUNDS, KAPPA = 8, 1 << 14, 1 << 17, 64, 1024, 3, 50.0
#: Probability with which a state stays as it is, at first.
STAY = 0.97
#: Tokens that run side by side in a task, and distinct words that a task holds before it sends their counts.
SIDE_BY_SIDE, HELD = 600_000, 400_000
END, OTHER = 0, 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(7)) == 2


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token binary, c) over all rows of docs; the empty token is the end."""

    def run(batches):
        found: Counter[bytes] = Counter()

        def send():
            names, n = pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())
            found.clear()
            return pa.RecordBatch.from_arrays([names, n], names=["token", "n"])

        for b in batches:
            for text in b.column(0):
                found.update(words_of(text.as_py()))
                found[b""] += 1
                if len(found) > HELD:
                    yield send()
        yield send()

    return docs.select(text_col).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words with their counts and symbols, and the sums that all formulas need."""

    words: list[bytes]  # the most frequent first
    counts: np.ndarray  # of words
    ends: int  # count of the end
    total: int  # N: all tokens
    distinct: int  # V: distinct tokens
    unigram: np.ndarray  # of symbols
    other_total: int
    other_distinct: int

    def base(self, c):
        return np.log10((c + 1) / (self.total + self.distinct + 1))

    def within_other(self, c):
        return np.log10((c + 1) / (self.other_total + self.other_distinct + 1))


def _level() -> Column:
    """Counts on a logarithmic scale of 32 levels to a doubling: at most 2016 levels."""
    return F.floor(F.log2("c") * 32).cast("int")


def lexicon(counts: DataFrame, symbols: int = SYMBOLS, head: int = HEAD) -> tuple[Lexicon, int]:
    """The lexicon and its least level of counts: it holds all words of at most LONGEST bytes from that level on.

    The level is read off a histogram, the lowest one above which at most head words stand.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.length("token") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    short = counts.where(F.length("token").between(1, LONGEST)).withColumn("level", _level())
    least, held = 0, 0
    for level, n in sorted(short.groupBy("level").count().collect(), reverse=True):
        held += n
        if held > head:
            least = level + 1
            break
    top = short.where(F.col("level") >= least).select("token", "c").toArrow()
    ranked = sorted(zip(top.column("c").to_pylist(), top.column("token").to_pylist()), key=lambda x: (-x[0], x[1]))
    names, c = [w for _, w in ranked], [n for n, _ in ranked]
    own = np.zeros(symbols)
    own[END], own[2 : 2 + len(c)] = ends, c[: symbols - 2]
    own[OTHER] = total - own.sum()
    named = min(len(c), symbols - 2) + (ends > 0)
    return Lexicon(names, np.array(c, np.int64), ends, total, distinct, (own + 1) / (total + symbols), int(own[OTHER]), distinct - named), least


@dataclass
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # SYMBOLS x STATES

    @staticmethod
    def first(unigram: np.ndarray, states: int = STATES) -> Model:
        rng = np.random.default_rng(7)
        emit = unigram[:, None] * rng.uniform(0.1, 1.9, (len(unigram), states))
        # States that last let neighbouring words agree on one, from which languages and topics grow apart.
        move = np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))

    def forward(self, lines: list[np.ndarray]) -> np.ndarray:
        """The natural logarithm of each line's probability; lines are sequences of symbols, none empty."""
        out = np.zeros(len(lines))
        for group in side_by_side(lines):
            steps, lengths = layout([lines[k] for k in group])
            alpha, at = None, 0
            log_p = np.zeros(len(group))
            for n in lengths:
                seen = self.emit[steps[at : at + n]]
                alpha = (self.start if alpha is None else alpha[:n] @ self.move) * seen
                scale = alpha.sum(1)
                alpha /= scale[:, None]
                log_p[:n] += np.log(scale)
                at += n
            out[group] = log_p
        return out

    def expect(self, lines: list[np.ndarray]) -> Counts:
        """Expected counts of starts, moves and emissions, and the lines' log-probability: scaled forward-backward."""
        states = len(self.start)
        got = Counts(np.zeros(states), np.zeros((states, states)), np.zeros_like(self.emit), 0.0)
        for group in side_by_side(lines):
            steps, lengths = layout([lines[k] for k in group])
            bounds = np.cumsum([0, *lengths])
            alpha, scale = np.empty((len(steps), states)), np.empty(len(steps))
            for t, n in enumerate(lengths):
                own = slice(bounds[t], bounds[t] + n)
                before = self.start if t == 0 else alpha[bounds[t - 1] : bounds[t - 1] + n] @ self.move
                alpha[own] = before * self.emit[steps[own]]
                scale[own] = alpha[own].sum(1)
                alpha[own] /= scale[own, None]
            got.log_p += np.log(scale).sum()
            gamma, beta = alpha, np.ones((lengths[-1], states))
            for t in range(len(lengths) - 1, -1, -1):
                own = slice(bounds[t], bounds[t + 1])
                if t + 1 < len(lengths):
                    n, nxt = lengths[t + 1], slice(bounds[t + 1], bounds[t + 2])
                    ahead = self.emit[steps[nxt]] * beta / scale[nxt, None]
                    got.move += alpha[bounds[t] : bounds[t] + n].T @ ahead
                    beta = np.ones((lengths[t], states))
                    beta[:n] = ahead @ self.move.T
                    # What stood in alpha after t is gamma by now: alpha of t is read before it is replaced.
                gamma[own] = alpha[own] * beta
            got.start += gamma[: lengths[0]].sum(0)
            for k in range(states):
                got.emit[:, k] += np.bincount(steps, gamma[:, k], len(self.emit))
        got.move *= self.move
        return got

    def update(self, got: Counts, unigram: np.ndarray) -> Model:
        start, move, emit = got.start + 1, got.move + 1, got.emit + KAPPA * unigram[:, None]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_p: float


def side_by_side(lines: list[np.ndarray]):
    """Groups of lines of about SIDE_BY_SIDE symbols, the longest first, so that lines of like length run together."""
    order = np.argsort([-len(x) for x in lines], kind="stable")
    group, held = [], 0
    for k in order:
        group.append(k)
        held += len(lines[k])
        if held >= SIDE_BY_SIDE:
            yield np.array(group)
            group, held = [], 0
    if group:
        yield np.array(group)


def alike(lines: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Lines in lots of about SIDE_BY_SIDE symbols, long ones with long ones: a lot takes as many steps as its longest line."""
    lots, held = ([], []), [0, 0]
    for x in lines:
        kind = int(len(x) > LONG)
        lots[kind].append(x)
        held[kind] += len(x)
        if held[kind] >= SIDE_BY_SIDE:
            yield lots[kind].copy()
            lots[kind].clear()
            held[kind] = 0
    yield from filter(None, lots)


def layout(lines: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Lines, longest first, as all first symbols, then all second ones, and so on; and how many lines reach each step."""
    lengths = np.array([len(x) for x in lines])
    step = np.concatenate([np.arange(n) for n in lengths])
    line = np.repeat(np.arange(len(lines)), lengths)
    order = np.lexsort((line, step))
    return np.concatenate(lines)[order].astype(np.int64), np.bincount(step).tolist()


def encode(docs: DataFrame, lex: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of docs: its symbols (two bytes each), sums over the words of the lexicon, and the others."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)
    id_type = docs.schema[id_col].dataType.simpleString()
    rest_type = pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int32())]))

    def run(batches):
        lex = sent.value
        # One more entry, reached as number -1, is for words outside the lexicon.
        number, named = {w: k for k, w in enumerate(lex.words)}, len(lex.unigram) - 2
        base = np.append(lex.base(lex.counts), 0.0)
        inner = np.append(lex.within_other(lex.counts), 0.0)
        inner[: min(named, len(lex.words))] = 0.0
        symbol = np.append(np.where(np.arange(len(lex.words)) < named, np.arange(len(lex.words)) + 2, OTHER), OTHER).astype("<u2")
        ends_known, ends_base = int(lex.ends > 0), float(lex.base(lex.ends))
        for b in batches:
            rows = []
            for text in b.column(2):
                words = words_of(text.as_py())
                at = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
                rest = Counter(words[k] for k in np.flatnonzero(at < 0).tolist())
                ids = np.append(symbol[at], np.array([END], "<u2")).tobytes()
                known = len(words) - rest.total() + ends_known
                rows.append((len(words) + 1, ids, known, base[at].sum() + ends_base, inner[at].sum(), [{"token": w, "tf": n} for w, n in rest.items()]))
            types = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), rest_type)
            columns = list(zip(*rows)) or [()] * len(types)
            new = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(3), *new], names=["row", "id", "held_out", "n_tokens", "ids", "known", "base", "inner", "rest"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return source.mapInArrow(run, f"row long, id {id_type}, held_out boolean, n_tokens long, ids binary, known long, base double, inner double, rest array<struct<token:binary,tf:int>>")


def train(coded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows coded(ids): the model, and the mean log10-probability of a symbol before each round."""
    model, history = Model.first(unigram, states), []
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        sent = coded.sparkSession.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            total, symbols = None, 0
            for lines in alike(np.frombuffer(v.as_py(), "<u2") for b in batches for v in b.column(0)):
                got, symbols = sent.value.expect(lines), symbols + sum(map(len, lines))
                if total is None:
                    total = got
                else:
                    total = Counts(total.start + got.start, total.move + got.move, total.emit + got.emit, total.log_p + got.log_p)
            if total is None:
                return
            at = np.flatnonzero(total.emit.sum(1) > 0)
            kind = np.concatenate([np.full(len(at), -1), np.arange(states), [states, states + 1]])
            index = np.concatenate([at, np.zeros(states + 2, np.int64)])
            sums = np.concatenate([total.emit[at], total.move, total.start[None, :], np.eye(1, states) * total.log_p + np.eye(1, states, 1) * symbols])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(index, pa.int32()), *(pa.array(sums[:, k]) for k in range(states))], names=["kind", "at", *names])

        rows = coded.select("ids").mapInArrow(lambda batches: run(batches), "kind int, at int, " + ", ".join(f"{n} double" for n in names))
        table = rows.groupBy("kind", "at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # SYMBOLS + STATES + 2 rows at most
        kind, at = table.column("kind").to_numpy(), table.column("at").to_numpy()
        sums = np.stack([table.column(n).to_numpy() for n in names], 1)
        got = Counts(np.zeros(states), np.zeros((states, states)), np.zeros((len(unigram), states)), 0.0)
        got.emit[at[kind == -1]] = sums[kind == -1]
        for k in range(states):
            got.move[k] = sums[kind == k].sum(0)
        got.start = sums[kind == states].sum(0)
        ends = sums[kind == states + 1].sum(0)
        history.append(float(ends[0] / max(ends[1], 1) / math.log(10)))
        model = model.update(got, unigram)
    return model, history


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS, head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    stage = Stage(spark)
    counts = stage.write(count_tokens(docs.where(~held_out(id_col)), text_col), "counts")
    lex, least = lexicon(counts, symbols, head)
    coded = stage.write(encode(docs, lex, id_col, text_col), "coded")
    model, _ = train(coded.where("not held_out"), lex.unigram, states, rounds)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lines = [np.frombuffer(v.as_py(), "<u2") for v in b.column("ids")]
            log_p = sent.value.forward(lines) / math.log(10) + b.column("inner").to_numpy() if lines else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "held_out", "n_tokens", "known", "base")), pa.array(log_p)], names=["row", "id", "held_out", "n_tokens", "known", "base", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = coded.select("row", "id", "held_out", "n_tokens", "ids", "known", "base", "inner").mapInArrow(run, f"row long, id {id_type}, held_out boolean, n_tokens long, known long, base double, score double")
    # Words outside the lexicon: only counts that can't be in it take part.
    rare = counts.where((_level() < least) | (F.length("token") > LONGEST))
    words = coded.select("row", F.explode("rest").alias("w")).select("row", "w.token", "w.tf").join(rare, "token", "left")
    c = F.coalesce("c", F.lit(0))
    by_row = words.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf"))).alias("more_known"),
        F.sum(F.col("tf") * F.log10((c + 1) / F.lit(float(lex.total + lex.distinct + 1)))).alias("more_base"),
        F.sum(F.col("tf") * F.log10((c + 1) / F.lit(float(lex.other_total + lex.other_distinct + 1)))).alias("more_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = scored.join(by_row, "row", "left")
    return out.select("id", "held_out", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"))


def op7_lm(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
