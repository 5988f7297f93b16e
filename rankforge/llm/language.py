"""Language identification by multilingual mixture inference.

Training: character trigram counts by language over all labelled training texts, hashed into BUCKETS numbers, give
one distribution for each language. Prediction: a text is a mixture of languages; expectation-maximisation finds
the proportions that make its trigrams likeliest. The set of languages is chosen by penalised likelihood (half a
log of the number of trigrams for each language beyond the first, and PRICE nats for each), over nested sets of any size
made of the languages with the largest proportions. The largest proportion of the chosen set gives the prediction.

Trigrams are made of letters (other characters become one blank), in lower case; a word has a blank at both ends.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text where nothing could be
learned; a null lang is not learned from; a null id counts as the empty text for the split; repeated rows and equal
texts get equal results; ties go to the smaller name; an empty table gives an empty result; extra columns are not
read. More than MAX_LANGUAGES labels raise an error, since the model (BUCKETS x labels) is sent to all executors.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import read, release

BUCKETS, SMOOTH, ROUNDS, PRICE, MAX_LANGUAGES = 1 << 14, 0.5, 12, 3.0, 500
UNKNOWN = "und"
FOLDS = 5
#: How far from the largest likelihood, in nats, a fit may end.
GAP = 1.0

# Letters by code point, built once in each worker.
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def trigrams(text: str | None) -> np.ndarray:
    """The bucket of each trigram of a text; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    ok = _letters()[codes]
    if not ok.any():
        return np.empty(0, np.int64)
    codes = np.where(ok, codes, 32)
    # One blank between words and at both ends.
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    codes = np.concatenate([[32], codes[keep], [32]])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    return ((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) >> 7) % BUCKETS


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == 0


class Model:
    """Languages in order of name and the log-probabilities of buckets by language; plain data."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        total = counts.sum(1, keepdims=True)
        self.p = ((counts + SMOOTH) / (total + SMOOTH * BUCKETS)).T.copy() if names else np.empty((BUCKETS, 0))
        self.log_p = np.log(self.p)

    def infer(self, texts: list[str | None]) -> list[tuple[str, float, dict[str, float]]]:
        """For each text its language, its score and the proportions of the languages chosen."""
        out: list[tuple[str, float, dict[str, float]]] = [(UNKNOWN, 0.0, {})] * len(texts)
        if not self.names:
            return out
        rows, weights, owners = [], [], []
        for k, text in enumerate(texts):
            grams = trigrams(text)
            if len(grams):
                n = np.bincount(grams, minlength=BUCKETS)
                at = np.flatnonzero(n)
                rows.append(at)
                weights.append(n[at])
                owners.append(k)
        if not owners:
            return out
        starts = np.cumsum([0, *map(len, rows[:-1])])
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at, c = np.concatenate(rows), np.concatenate(weights).astype(float)
        n = np.add.reduceat(c, starts)
        p = self.p[at]
        single = np.add.reduceat(self.log_p[at] * c[:, None], starts, axis=0)
        theta, most = self._fit(np.full((len(rows), len(self.names)), 1 / len(self.names)), p, c, n, doc, starts)
        best = np.argmax(single, axis=1)
        chosen = np.zeros_like(theta)
        chosen[np.arange(len(rows)), best] = 1.0
        value = single[np.arange(len(rows)), best]
        # No set beats the likelihood of all languages together: where that is too little for a second one, one stays.
        price = 0.5 * np.log(n) + PRICE
        open_ = np.flatnonzero(most + GAP - price > value)
        if len(open_):
            own = np.isin(doc, open_)
            p, c, n, price, theta = p[own], c[own], n[open_], price[open_], theta[open_]
            sizes = np.array([len(rows[k]) for k in open_])
            starts, doc = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(open_)), sizes)
            order = np.argsort(-theta, axis=1, kind="stable")
            for size in range(2, len(self.names) + 1):
                # Nor does a set of this size or a larger one, where the same bound is too little for any text.
                if not (most[open_] + GAP - (size - 1) * price > value[open_]).any():
                    break
                if size == len(self.names):
                    fit, likelihood = theta, most[open_]
                else:
                    first = np.zeros_like(theta)
                    np.put_along_axis(first, order[:, :size], np.take_along_axis(theta, order[:, :size], 1) + 1e-9, 1)
                    fit, likelihood = self._fit(first / first.sum(1, keepdims=True), p, c, n, doc, starts)
                penalised = likelihood - (size - 1) * price
                better = penalised > value[open_]
                at = open_[better]
                value[at], chosen[at] = penalised[better], fit[better]
        top = np.argmax(chosen, axis=1)
        for k, t, shares in zip(owners, top, chosen):
            out[k] = (self.names[t], float(min(1.0, shares[t])), {self.names[i]: float(shares[i]) for i in np.flatnonzero(shares > 1e-6)})
        return out

    @staticmethod
    def _fit(theta, p, c, n, doc, starts):
        """Proportions by expectation-maximisation from theta (zeros stay), and their log-likelihoods, within GAP of the largest one.

        With g the gradient, no proportions over the same languages reach more than n log(max g / n) beyond the
        likelihood here (Jensen). Texts that are further from it go on.
        """
        theta, most, live = theta.copy(), np.zeros(len(theta)), np.arange(len(theta))
        there = theta > 0
        while len(live):
            own = theta[live]
            for _ in range(ROUNDS):
                share = p * own[doc]
                share *= (c / share.sum(1))[:, None]
                own = np.add.reduceat(share, starts, axis=0) / n[:, None]
            mixed = (p * own[doc]).sum(1)
            theta[live], most[live] = own, np.add.reduceat(np.log(mixed) * c, starts)
            slope = np.where(there[live], np.add.reduceat(p * (c / mixed)[:, None], starts, axis=0), 0.0).max(1)
            on = n * np.log(slope / n) > GAP
            if not on.any():
                break
            rows = on[doc]
            sizes = np.diff(np.append(starts, len(doc)))[on]
            live, n, p, c = live[on], n[on], p[rows], c[rows]
            starts, doc = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(live)), sizes)
        return theta, most


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows of docs whose lang is not null.

    Tasks send one row of BUCKETS counts for each language they meet; the sums, bounded by MAX_LANGUAGES x BUCKETS
    whatever the input, come to the driver.
    """

    def count(batches):
        release()
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = trigrams(text)
                if len(grams):
                    # By language first, and block by block to the sums: a new label costs one row of counts.
                    own = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(grams, minlength=BUCKETS)
            if len(found) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])

    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    counts = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))
    rows = by_lang.limit(MAX_LANGUAGES + 1).toArrow()
    if rows.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(rows.column("lang").to_pylist())
    table = np.zeros((len(names), BUCKETS))
    for lang, at, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "at", "n"))):
        table[names.index(lang), at] = n
    return Model(names, table)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", batch: int = 128, least: float | None = None) -> DataFrame:
    """Columns keep of docs, with lang_pred, score and shares (language to proportion), one row for each row.

    least: columns keep alone, of the rows whose language is known and holds at least that share.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES x BUCKETS
    # Texts go to the tasks once, even if they are among the columns to keep.
    names = [*keep, *[text_col] * (text_col not in keep)]
    source, text_at = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(names))), names.index(text_col)
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[: len(keep)]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                got = sent.value.infer(b.column(text_at).to_pylist())
                shares = pa.array([list(s.items()) for *_, s in got], pa.map_(pa.string(), pa.float64()))
                new = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), shares]
                yield pa.RecordBatch.from_arrays(b.columns[: len(keep)] + new, names=[*b.schema.names[: len(keep)], "lang_pred", "score", "shares"])

    out = source.mapInArrow(run, f"{kinds}, lang_pred string, score double, shares map<string,double>")
    kept = [F.col(f"k{i}").alias(k) for i, k in enumerate(keep)]
    if least is not None:
        return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*kept)
    return out.select(*kept, "lang_pred", "score", "shares")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares); learned from labelled documents outside the held-out fifth."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model, ["doc_id"]).withColumn("held_out", held_out())


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs whose leading language is known and holds at least a share of least of the text."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model, docs.columns, least=least)


def op5_language(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
