"""From raw documents to token files: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstrata.llm import decontaminate, mixing, simhash, token_files, toxicity
from bidstrata.llm.common import free_names, load, shared_folder
from bidstrata.llm.queries import LANGUAGE_WEIGHTS, labelled_languages


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (score of 0.3 or more)."""
    model = toxicity.fit_toxicity(docs, load(spark, sf_dir, "labels"))
    (score,) = free_names(docs, "toxicity")
    return toxicity.with_toxicity(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of three-word shingles within three bits the one of least doc_id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages below their target are repeated until the expected words match; none is dropped."""
    rates, _ = mixing.mixing_rates(docs, labelled_languages(spark, sf_dir), LANGUAGE_WEIGHTS, floor=1.0)
    return mixing.apply_rates(docs, rates)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in order of doc_id, and what they hold."""
    return token_files.write_and_digest(
        docs, public_tokenizers.path("word_bpe_49k.json"), 1, metadata=["lang", "source"],
        piece_bytes=1 << 20, thrifty=True)  # the workers still hold memory from the stages before


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_languages),
    ("token_files", write_ids),
]

#: SQL has no classifiers and no tokenizer; tests/llm/test_pipeline.py compares with a plain computation instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
