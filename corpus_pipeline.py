"""A training corpus from documents, in five stages; each is written as Parquet and read again as the next one's docs.

Language identification drops documents without a known leading language, near-dedup keeps one document of each group
of near copies (first by SimHash tiles, then by a prefix filter; every link is verified), the secret scan blanks owner-specific credentials, the mix takes documents as often as their
source's target asks for (so a document may be there twice, or not at all), and the last stage encodes and decodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import bpe, language, mixing, secrets, simhash
from rankforge.llm.common import Stage, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded) for each row; ids are little-endian unsigned 32-bit integers."""
    key = docs.select(F.struct("doc_id", "lang", "source").alias("key"), "text")
    return bpe.encode(key, "key").select("id.doc_id", "id.lang", "id.source", "n_tokens", "ids", "decoded")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", blank_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: Language mixtures, fingerprints' components and the cube method are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark), read(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES):
        before = len(Stage.made)
        done = stage.write(apply(spark, docs, sf_dir), f"stage{k}")
        Stage.sweep(before)
        if k:
            stage.drop(docs)
        docs = done
    return docs
