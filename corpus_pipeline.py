"""Documents to training files: five stages, each over all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeseek.llm import decontamination, mixing, near_dups, quality, token_files
from tomeseek.llm.common import free_name, table
from tomeseek.llm.queries import EPOCHS, SEED, SHARE, VOCABULARY, WEIGHTS
from tomeseek.session import new_folder, written

#: No SQL: the classifier and the fingerprints can't be expressed; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on those of ``docs`` that have a label, does not reject."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality.score_quality(docs, model).where(F.col(score) >= quality.KEEP).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dups.drop_near_duplicates(docs, words=5, similarity=0.8)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.mixed_documents(docs, domain=mixing.domain_of("source"), share=SHARE, weights=WEIGHTS, epochs=EPOCHS, seed=SEED)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents; each document's place in them and checksum, as read back."""
    files = token_files.write_token_files(docs, new_folder(spark, "tokens"), public_tokenizers.path(VOCABULARY))
    return token_files.read_documents(spark, files)


STAGES = [
    ("quality", good_text),
    ("near duplicates", one_of_each),
    ("decontamination", free_of_benchmark),
    ("mixing", mixed),
    ("token files", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
