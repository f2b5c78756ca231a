"""The collection as a whole: its exact copies and its profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeseek.plans.joins import join_small
from tomeseek.session import written


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, kept_id, n: each document, the lowest id with the same text, and how many have it.

    Texts are the same if they differ in case and blanks only; NULL counts as
    empty. Hashes are shuffled, never texts, and counted in each task before; a
    text that a third of all documents share goes back to them over many tasks.
    """
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\f\r]+", " "))
    hashed = written(docs.select("doc_id", F.sha2(F.coalesce(plain, F.lit("")), 256).alias("hash")), "text-hashes")
    classes = hashed.groupBy("hash").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n"))
    return join_small(hashed, written(classes, "text-classes"), "hash", ["doc_id"]).select("doc_id", "kept_id", "n")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies of a document of lower id."""
    kept = exact_copies(docs).where("doc_id = kept_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")


def corpus_profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by lang and source, by lang, and of all: level 0, 1 and 3.

    n_docs, n_chars, n_copies (of a document of lower id), n_labelled and the
    shares of these that are good and toxic (NULL where none is labelled).
    ``labels`` has a document at most once.
    """
    copies = exact_copies(docs).select("doc_id", (F.col("doc_id") != F.col("kept_id")).cast("bigint").alias("copy"))
    about = docs.select("doc_id", "lang", "source", "n_chars").join(copies, "doc_id")
    about = about.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return about.rollup("lang", "source").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"),
        F.sum("copy").alias("n_copies"), F.count("quality").alias("n_labelled"),
        F.round(F.avg("quality"), 6).alias("good"), F.round(F.avg("toxic"), 6).alias("toxic"))
