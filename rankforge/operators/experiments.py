"""Experiments: a folder of parameter files, each run and compared with a baseline; wall time."""

from __future__ import annotations

import re
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rankforge.operators.evaluate import map_per_query, win_tie_loss
from rankforge.plans import pipeline
from rankforge.sources import trec
from rankforge.sources.index import Index
from rankforge.sources.params import read_parameters


class Timer:
    def __init__(self):
        self.began, self.taken = None, 0.0

    def start(self) -> Timer:
        self.began = time.perf_counter()
        return self

    def stop(self) -> Timer:
        self.taken, self.began = time.perf_counter() - self.began, None
        return self

    def __str__(self) -> str:
        return f"{self.taken:.1f} secs"


def discover(folder: str, prefix: str = "") -> list[str]:
    """Names of the cases: parameter files with a prefix, by name."""
    return sorted(p.stem for p in Path(folder).glob(f"{prefix}*.param") if re.match(re.escape(prefix), p.stem))


def output_path(params: dict) -> str:
    return next(p["outputPath"] for k, p in params.items() if pipeline.kind_of(k) == "output")


def run_cases(spark: SparkSession, folder: str, cases: list[str], index: Index | None = None) -> dict[str, tuple[str, Timer]]:
    """Run file and time of each case."""
    out = {}
    for case in cases:
        params = read_parameters(f"{folder}/{case}.param")
        timer = Timer().start()
        pipeline.run(spark, params, index)
        out[case] = output_path(params), timer.stop()
    return out


def compare(spark: SparkSession, qrels: DataFrame, baseline: str, runs: dict[str, str], threshold: float = 0.02) -> dict[str, DataFrame]:
    """(qid, base, exp, outcome) of each run file against the baseline's."""
    base = map_per_query(trec.read_run(spark, baseline), qrels)
    return {name: win_tie_loss(base, map_per_query(trec.read_run(spark, path), qrels), threshold) for name, path in runs.items()}
