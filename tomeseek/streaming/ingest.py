"""New document files to the index, once each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeseek import schemas
from tomeseek.functions.text import doc_hash
from tomeseek.operators.indexing import refresh_index
from tomeseek.sources.index import Index, open_index


def ingest_stream(
    spark: SparkSession, source: str, index: Index, checkpoint: str, max_files: int | None = None
) -> Index:
    """Index all document files in ``source`` that ``checkpoint`` has not seen, then stop.

    Each micro-batch becomes the next batch of the index. Documents the index
    has in the same form are skipped, others are added or replaced. A batch is
    published with the stream's id and the micro-batch's number, so one that is
    run again after it was published does nothing, and one that was cut off
    before is written anew. The index may be refreshed by other jobs between two
    runs of the stream. There is no operator state that grows: what has been
    seen is in the index itself.
    """
    stream_id = _stream_id(spark, checkpoint)

    def add(docs: DataFrame, batch_id: int) -> None:
        current = open_index(docs.sparkSession, index.path)
        origin = f"{stream_id}:{batch_id}"
        if not current.has_batch_of(origin):
            refresh_index(current, _one_for_each_id(docs), remove_missing=False, origin=origin)

    stream = spark.readStream.schema(schemas.DOCUMENTS)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    query = (
        stream.parquet(source).writeStream.foreachBatch(add)
        .option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return open_index(spark, index.path)


def _one_for_each_id(docs: DataFrame) -> DataFrame:
    """If a micro-batch has a document twice, the one with the lower hash: the same in a re-run."""
    keyed = docs.select("doc_id", doc_hash().alias("hash"), F.struct(*docs.columns).alias("doc"))
    return keyed.groupBy("doc_id").agg(F.min_by("doc", "hash").alias("doc")).select("doc.*")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name of the stream, fixed when it first starts."""
    row = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("stream_id"))
    row.coalesce(1).write.mode("ignore").parquet(f"{checkpoint}/stream_id")
    return spark.read.parquet(f"{checkpoint}/stream_id").first()["stream_id"]
