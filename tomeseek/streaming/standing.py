"""Standing questions: documents are matched with kept questions as they arrive.

The index is one of questions: each is filed under a single word, its rarest, so a
document meets only the questions of the words it has, however many are kept, and is then
compared with all words of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeseek import schemas
from tomeseek.functions.text import words
from tomeseek.plans.joins import is_small, join_small
from tomeseek.session import written

MATCHES = "query_id bigint, doc_id bigint"


def file_questions(queries: DataFrame, term_stats: DataFrame | None = None) -> DataFrame:
    """query_id, needs (the question's words, each once), term (the one it is filed under), as a written table.

    That is the word that ``term_stats`` (term, df) has seen least, of equals or without counts the longest,
    then the first by name. A question without a word is never matched and has no row.
    """
    asked = queries.select(F.col("query_id").cast("bigint"), F.array_distinct(words(F.col("text"))).alias("needs")).where(F.size("needs") > 0)
    each = asked.select("query_id", F.explode("needs").alias("term"))
    if term_stats is None:
        each = each.withColumn("df", F.lit(0).cast("bigint"))
    else:
        each = each.join(term_stats.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = each.groupBy("query_id").agg(F.min(F.struct("df", (-F.length("term")).alias("letters"), "term")).alias("rarest"))
    return written(asked.join(rarest.select("query_id", "rarest.term"), "query_id"), "questions")


def match_questions(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, doc_id: documents (doc_id, text) that hold all words of a question, each pair once.

    ``questions`` is the result of ``file_questions``. Only words are shuffled, and only where the
    questions are too many to be broadcast; a word that many questions are filed under is spread over tasks.
    """
    small = is_small(questions)
    bodies = docs.select("doc_id", F.array_distinct(words(F.col("text"))).alias("has"))
    filed = questions.select("query_id", "term")
    if small:
        # Documents stay where they are: words meet the questions and the document's other words are at hand.
        met = bodies.select("doc_id", "has", F.explode("has").alias("term")).join(F.broadcast(filed), "term").drop("term")
        pairs = met.join(F.broadcast(questions.select("query_id", "needs")), "query_id")
    else:
        met = join_small(bodies.select("doc_id", F.explode("has").alias("term")), filed, "term", ["doc_id"], False).drop("term")
        pairs = join_small(met.join(bodies, "doc_id"), questions.select("query_id", "needs"), "query_id", ["doc_id"], False)
    return pairs.where(F.size(F.array_except("needs", "has")) == 0).select("query_id", F.col("doc_id").cast("bigint").alias("doc_id")).distinct()


def match_stream(
    spark: SparkSession, source: str, questions: DataFrame, out: str, checkpoint: str, max_files: int | None = None
) -> DataFrame:
    """Match all document files in ``source`` that ``checkpoint`` has not seen with the questions, then stop; see ``matches``.

    A micro-batch writes the matches of its documents to a folder of its own number, in place of an earlier
    try: one that is run again adds nothing. There is no state that grows.
    """
    def add(docs: DataFrame, batch_id: int) -> None:
        match_questions(docs, questions).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schemas.DOCUMENTS)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    query = (
        stream.parquet(source).writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return matches(spark, out)


def matches(spark: SparkSession, out: str) -> DataFrame:
    """query_id, doc_id of all matches so far; a document that came twice counts once."""
    return spark.read.schema(f"{MATCHES}, batch int").parquet(out).select("query_id", "doc_id").distinct()
