"""Licence scans: ordered signature rules behind a keyword prefilter.

One pass over the whole texts. A text becomes its words joined by single spaces (bytes; A-Z lower-cased, ASCII
other than letters and digits separates). An Aho-Corasick automaton finds which rules have all their keywords in
it; only those patterns run. A detection that lies inside a kept one of the same or a higher rank is suppressed;
what is left, and the base phrases, which are never suppressed, are the result.

Defined results: a null or empty text has no words, no places and score 0; repeated rows are scanned one by one; an
empty table gives an empty result; only the id and the text are read, so extra columns don't matter.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import read
from rankforge.llm.license_rules import rules

#: Phrases whose every place counts, and their labels.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))
BASE_SCORE = 0.5

# Bytes of words stay, A-Z in lower case; all others become a space. Bytes from 0x80 on are parts of words.
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Scanner:
    def __init__(self):
        self.rules = rules()
        whole = rb"(?<![^ ])(?:%s)(?![^ ])"
        self.patterns = [re.compile(whole % p.encode()) for *_, p in self.rules]
        self.base = [re.compile(whole % p) for p, _ in BASE]
        self.needs: list[frozenset[int]] = []
        keys: dict[str, int] = {}
        for _, _, _, words, _ in self.rules:
            self.needs.append(frozenset(keys.setdefault(w.encode().decode("latin-1"), len(keys)) for w in words))
        self.base_keys = [keys.setdefault(p.decode("latin-1"), len(keys)) for p, _ in BASE]
        self.keys = ahocorasick.Automaton()
        for w, k in keys.items():
            self.keys.add_word(w, k)
        self.keys.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, float]], list[tuple[int, int, str]]]:
        """Word count; kept detections (first word, word after the last, label, confidence); base places likewise."""
        words = words_of(text)
        joined = b" ".join(words)
        there = {k for _, k in self.keys.iter(joined.decode("latin-1"))}
        if not there:
            return len(words), [], []
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        # A rule's group, if it has one, is what it detects.
        at = lambda m: tuple(int(np.searchsorted(gaps, x)) + k for k, x in enumerate(m.span(m.re.groups)))
        base = [(*at(m), label) for key, p, (_, label) in zip(self.base_keys, self.base, BASE) if key in there for m in p.finditer(joined)]
        raw = []
        for (label, rank, confidence, _, _), need, p in zip(self.rules, self.needs, self.patterns):
            if need <= there:
                raw += [(rank, *at(m), label, confidence) for m in p.finditer(joined)]
        return len(words), suppress(raw), base


def suppress(raw: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Detections (rank, start, end, label, confidence) without those inside another of the same or a higher rank.

    Of equal intervals the better rank, then the higher confidence, then the smaller label stays.
    """
    kept: list[tuple[int, int, str, float]] = []
    # Ranks from the best on; within a rank by start, the longest first. Kept intervals are held as the largest end
    # reached by each start, so a text with thousands of detections costs a binary search for each.
    starts, ends = np.empty(0, np.int64), np.empty(0, np.int64)
    for rank in sorted({r[0] for r in raw}):
        own = sorted((r for r in raw if r[0] == rank), key=lambda r: (r[1], -r[2], -r[4], r[3]))
        reach, fresh = -1, []
        for _, start, end, label, confidence in own:
            k = np.searchsorted(starts, start, "right") - 1
            if end <= reach or k >= 0 and ends[k] >= end:
                continue
            reach = end
            fresh.append((start, end, label, confidence))
        kept += fresh
        starts = np.concatenate([starts, np.array([x[0] for x in fresh], np.int64)])
        ends = np.concatenate([ends, np.array([x[1] for x in fresh], np.int64)])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
    return sorted(kept)


SCHEMA = (
    "id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<start:long,end:long,label:string,confidence:double>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: word count, base places, labels and all kept detections in words."""
    schema = SCHEMA.format(docs.schema[id_col].dataType.simpleString())
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))

    def run(batches):
        scanner = Scanner()
        for b in batches:
            rows = []
            for t in b.column(1):
                n, kept, base = scanner.scan(t.as_py())
                at = [s for s, _, _ in base]
                named = {x for *_, x in base}
                score = max([c for *_, c in kept] + [BASE_SCORE] * bool(base), default=0.0)
                rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(named)), ",".join(sorted(named | {x[2] for x in kept})), score, [dict(zip(("start", "end", "label", "confidence"), x)) for x in kept]))
            types = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), kinds)
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
