"""Queries of this package, by name, and DuckDB SQL for those that SQL can express.

Where SQL knows only the base columns of an operator's result, these are a query of their own beside it, with SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import ann, bpe, embedding_dedup, hmm, language, licenses, mixing, oracle, passages, secrets, simhash


def licenses_base(spark, sf_dir):
    return licenses.op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secrets_base(spark, sf_dir):
    return secrets.op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base(spark, sf_dir):
    return hmm.op7_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def mixing_targets(spark, sf_dir):
    return mixing.op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_licenses": licenses.op2_licenses,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_language": language.op5_language,
    "op6_passages": passages.op6_passages,
    "op7_lm": hmm.op7_lm,
    "op8_bpe": bpe.op8_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_ann": ann.op10_ann,
    "pipeline": corpus_pipeline.run,
    "licenses_base": licenses_base,
    "secrets_base": secrets_base,
    "lm_base": lm_base,
    "mixing_targets": mixing_targets,
}

ORACLE_SQL = {
    "op3_embedding_dedup": oracle.EMBEDDINGS,
    "licenses_base": oracle.LICENSES,
    "secrets_base": oracle.SECRETS,
    "lm_base": oracle.LM,
    "mixing_targets": oracle.MIXING,
}
