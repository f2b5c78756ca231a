"""The inverted index: Parquet tables in one folder, registered in the catalog.

``passages``, ``postings``, ``doc_state`` and ``retired`` are bucketed by
``doc_id``, so work within a document or passage (scores, key terms, names)
needs no shuffle of the index: each task holds whole documents. ``doc_id`` is
hashed, so neither a source nor a group of copies can fill a bucket.

Every table is partitioned by ``batch``. Batch 0 is the first build and each
later batch holds what changed. A batch is published by its row in
``corpus_stats``, which is written last and names where the batch came from and
the first batch that still counts (``base``): a merged batch is its own base.
What is published is never written again; a batch that was cut off before is
replaced by the next one, which gets its number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeseek import schemas
from tomeseek.functions.text import doc_hash
from tomeseek.operators import passages as cutting
from tomeseek.plans.joins import is_small
from tomeseek.session import written

# Table: columns, sort order within a bucket (None: not bucketed).
TABLES = {
    "passages": (schemas.PASSAGES, "doc_id, chunk"),
    "postings": (schemas.POSTINGS, "term, doc_id, chunk"),
    "doc_state": (schemas.DOC_STATE, "doc_id"),
    "retired": (schemas.RETIRED, "doc_id"),
    "term_stats": (schemas.TERM_STATS, None),
    "corpus_stats": (schemas.CORPUS_STATS, None),
}
#: A task sorts the postings of a bucket in memory: about 32 bytes for each character.
CHARS_PER_BUCKET = 16 * 1024 * 1024
MAX_BUCKETS = 100_000  # Spark's own limit
#: Documents up to which their ids are pushed to the readers, which then open only their buckets.
PUSHED_IDS = 500


class Index:
    """A snapshot of the index: all published batches from ``base`` up to ``last_batch``."""

    def __init__(self, spark: SparkSession, path: str, size: int, step: int, last_batch: int, base: int = 0):
        self.spark, self.path, self.size, self.step, self.last_batch, self.base = spark, path, size, step, last_batch, base
        self._any_retired: bool | None = None

    def before(self, batch: int) -> "Index":
        """The snapshot that ended just before ``batch``."""
        return _snapshot(self.spark, self.path, self.size, self.step, min(self.last_batch, batch - 1))

    def n_buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/layout").first().n_buckets

    def table(self, name: str) -> DataFrame:
        return self.spark.table(table_name(self.path, name)).where(F.col("batch").between(self.base, self.last_batch))

    def _live(self, name: str) -> DataFrame:
        """Rows of documents no later batch has replaced or removed."""
        rows = self.table(name)
        gone = self.table("retired")
        if self._any_retired is None:
            self._any_retired = self.last_batch > self.base and not gone.isEmpty()
        if not self._any_retired:
            return rows.drop("batch")
        gone = gone.groupBy("doc_id").agg(F.max("batch").alias("gone_in"))
        if is_small(gone):
            gone = F.broadcast(gone)
        dead = (rows["doc_id"] == gone["doc_id"]) & (rows["batch"] < gone["gone_in"])
        return rows.join(gone, dead, "left_anti").drop("batch")

    def passages(self) -> DataFrame:
        return self._live("passages")

    def postings(self) -> DataFrame:
        return self._live("postings")

    def doc_state(self) -> DataFrame:
        return self._live("doc_state")

    def term_stats(self) -> DataFrame:
        """term, df in passages, doc_df in documents. Batches add to and take from the counts."""
        counts = self.table("term_stats")
        summed = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("doc_df").alias("doc_df"))
        return summed.where(F.col("df") > 0)

    def term_stats_of(self, terms: DataFrame) -> DataFrame:
        """The same for the given terms only, which are looked up before the counts are added up."""
        wanted = terms.select("term")
        if is_small(wanted):
            wanted = F.broadcast(wanted)
        counts = self.table("term_stats").join(wanted, "term", "left_semi")
        summed = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("doc_df").alias("doc_df"))
        return summed.where(F.col("df") > 0)

    def has_batch_of(self, origin: str) -> bool:
        """Whether a published batch came from ``origin``, be it merged since or not."""
        rows = self.spark.table(table_name(self.path, "corpus_stats")).where(F.col("batch") <= self.last_batch)
        return not rows.where(F.col("origin") == origin).isEmpty()

    def corpus_stats(self) -> DataFrame:
        """One row: n passages, total_len words in them, avgdl, n_docs."""
        counts = self.table("corpus_stats").agg(
            F.sum("n").alias("n"), F.sum("total_len").alias("total_len"), F.sum("n_docs").alias("n_docs")
        )
        return counts.withColumn("avgdl", F.try_divide("total_len", "n"))

    def corpus_value(self, name: str):
        """A corpus count as a scalar subquery, to be used within an expression."""
        return self.corpus_stats().select(name).scalar()


def table_name(path: str, name: str) -> str:
    return f"tomeseek_{hashlib.md5(path.rstrip('/').encode()).hexdigest()[:12]}_{name}"


def bucket_count(docs: DataFrame) -> int:
    """Buckets for a corpus: one for each 16 Mi characters, at least one for each core.

    Reads only the length column.
    """
    chars = docs.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return int(min(max(cores, -(-chars // CHARS_PER_BUCKET)), MAX_BUCKETS))


def create_index(
    spark: SparkSession, path: str, n_buckets: int, size: int = cutting.SIZE, step: int = cutting.STEP
) -> Index:
    """Empty index tables in ``path``."""
    layout = spark.range(1).select(
        F.lit(n_buckets).alias("n_buckets"), F.lit(size).alias("size"), F.lit(step).alias("step")
    )
    layout.coalesce(1).write.parquet(f"{path}/layout")
    _register(spark, path)
    for name in TABLES:  # an empty first partition, so that every table has its folder
        spark.sql(f"ALTER TABLE {table_name(path, name)} ADD IF NOT EXISTS PARTITION (batch = -1)")
    return Index(spark, path, size, step, -1)


def _register(spark: SparkSession, path: str):
    layout = spark.read.parquet(f"{path}/layout").first()
    for name, (columns, order) in TABLES.items():
        buckets = f"CLUSTERED BY (doc_id) SORTED BY ({order}) INTO {layout.n_buckets} BUCKETS" if order else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table_name(path, name)} ({columns}, batch int) USING parquet "
            f"PARTITIONED BY (batch) {buckets} LOCATION '{path}/{name}'"
        )
    return layout


def open_index(spark: SparkSession, path: str) -> Index:
    """The index in ``path``, registered in this session's catalog with all its batches."""
    layout = _register(spark, path)
    for name in TABLES:
        spark.sql(f"MSCK REPAIR TABLE {table_name(path, name)}")
        spark.catalog.refreshTable(table_name(path, name))
    return _snapshot(spark, path, layout["size"], layout["step"])


def _snapshot(spark: SparkSession, path: str, size: int, step: int, last: int | None = None) -> Index:
    """The newest snapshot, or the one that ends with batch ``last``."""
    rows = spark.table(table_name(path, "corpus_stats"))
    if last is not None:
        rows = rows.where(F.col("batch") <= last)
    found = rows.agg(F.max("batch").alias("last"), F.max("base").alias("base")).first()
    return Index(spark, path, size, step, -1 if found["last"] is None else found["last"], found["base"] or 0)


def _put(index: Index, name: str, rows: DataFrame, batch: int) -> DataFrame:
    """Write ``rows`` as one batch of a table, in place of an earlier try; returns them as stored."""
    spark = rows.sparkSession
    columns, order = TABLES[name]
    target = table_name(index.path, name)
    wanted = rows.select(*[c.split()[0] for c in columns.split(", ")])
    spark.sql(f"INSERT OVERWRITE TABLE {target} PARTITION (batch = {batch}) SELECT * FROM {{rows}}", rows=wanted)
    return spark.table(target).where(F.col("batch") == batch).drop("batch")


def _move(index: Index, name: str, rows: DataFrame, batch: int) -> None:
    """Write ``rows`` of a table as another batch of it. Spark overwrites no table that it reads: what an earlier try left goes first."""
    columns = TABLES[name][0]
    _put(index, name, index.spark.createDataFrame([], columns), batch)
    wanted = rows.select(*[c.split()[0] for c in columns.split(", ")])
    index.spark.sql(f"INSERT INTO TABLE {table_name(index.path, name)} PARTITION (batch = {batch}) SELECT * FROM {{rows}}", rows=wanted)


@contextmanager
def _by_bucket(spark: SparkSession) -> Iterator[None]:
    """A task for each bucket that is read. Spark would drop the buckets of a scan that no join or sum needs, give a
    task as many as fit a split, all of which it then sorts at once, and write each bucket in many files."""
    setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    was = spark.conf.get(setting, None)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.unset(setting) if was is None else spark.conf.set(setting, was)


def _term_counts(posts: DataFrame) -> DataFrame:
    """df and doc_df. The inner level is within documents, hence within a bucket."""
    by_doc = posts.groupBy("doc_id", "term").agg(F.count("*").alias("in_doc"))
    return by_doc.groupBy("term").agg(F.sum("in_doc").alias("df"), F.count("*").alias("doc_df"))


def _corpus_counts(cut: DataFrame) -> DataFrame:
    return cut.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_len"),
        F.coalesce(F.sum((F.col("chunk") == 0).cast("bigint")), F.lit(0)).alias("n_docs"),
    )


def write_batch(index: Index, docs: DataFrame, batch: int, retired: DataFrame | None = None, origin: str | None = None) -> Index:
    """Add ``docs`` and take out the documents in ``retired``, as batch number ``batch``, the next one.

    The only shuffle of the text is the one that puts documents into buckets.
    """
    if batch <= index.last_batch:
        raise ValueError(f"batch {batch} is published already")
    spark = docs.sparkSession
    n_buckets = index.n_buckets()
    bucketed = docs.select("doc_id", "text", "lang", "source").repartition(n_buckets, "doc_id")
    cut = _put(index, "passages", cutting.passages(bucketed, index.size, index.step), batch)
    with _by_bucket(spark):
        posts = _put(index, "postings", cutting.postings(cut, index.step), batch)
    state = docs.select("doc_id", doc_hash().alias("doc_hash"))
    _put(index, "doc_state", state.repartition(n_buckets, "doc_id"), batch)

    terms, corpus = _term_counts(posts), _corpus_counts(cut)
    if retired is None:
        retired = spark.range(0).withColumnRenamed("id", "doc_id")
    else:
        gone = of_documents(index.before(batch).passages(), retired)
        gone = written(gone.select("doc_id", "chunk", "n_tokens", F.array_distinct("tokens").alias("terms")), "retired-passages")
        lost = gone.select("doc_id", "chunk", F.explode("terms").alias("term"))
        minus = _term_counts(lost).select("term", (-F.col("df")).alias("df"), (-F.col("doc_df")).alias("doc_df"))
        terms = terms.unionByName(minus)
        less = _corpus_counts(gone)
        corpus = corpus.unionByName(less.select(*[(-F.col(c)).alias(c) for c in less.columns]))
        corpus = corpus.agg(*[F.sum(c).alias(c) for c in less.columns])
    _put(index, "retired", retired, batch)
    _put(index, "term_stats", terms, batch)
    return _publish(index, corpus, batch, origin, index.base)


def _publish(index: Index, corpus: DataFrame, batch: int, origin: str | None, base: int) -> Index:
    """The row that makes a batch count, and the snapshot that ends with it."""
    _put(index, "corpus_stats", corpus.withColumns({"origin": F.lit(origin).cast("string"), "base": F.lit(base)}), batch)
    return Index(index.spark, index.path, index.size, index.step, max(index.last_batch, batch), base)


def of_documents(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` of an index table for the documents of ``ids``, a written table.

    A few ids are pushed to the reader, which opens only their buckets and row
    groups: the cost follows the ids, not the index.
    """
    few = [r["doc_id"] for r in ids.select("doc_id").limit(PUSHED_IDS + 1).collect()]
    if len(few) <= PUSHED_IDS:
        return rows.where(F.col("doc_id").isin(few))
    return rows.join(F.broadcast(ids) if is_small(ids) else ids, "doc_id", "left_semi")


def merge_batches(index: Index) -> Index:
    """All that counts, written as one new batch that is its own base. What is there is only read.

    The tables are read by bucket and written to the same buckets, so nothing
    but the counts of terms is shuffled.
    """
    batch, spark = index.last_batch + 1, index.spark
    with _by_bucket(spark):
        for name in ("passages", "postings", "doc_state"):
            _move(index, name, index._live(name), batch)
    _put(index, "retired", spark.range(0).withColumnRenamed("id", "doc_id"), batch)
    _move(index, "term_stats", index.term_stats(), batch)
    return _publish(index, written(index.corpus_stats().drop("avgdl"), "corpus-counts"), batch, None, batch)


def empty_batches(index: Index) -> None:
    """Take the rows out of all batches before the snapshot's base. Snapshots from before the merge can't be read afterwards.

    ``corpus_stats`` keeps its few rows, which say where each batch came from.
    """
    for name in TABLES:
        if name != "corpus_stats":
            rows = index.spark.table(table_name(index.path, name))
            for row in rows.where(F.col("batch") < index.base).select("batch").distinct().orderBy("batch").collect():
                _put(index, name, index.spark.createDataFrame([], TABLES[name][0]), row["batch"])
