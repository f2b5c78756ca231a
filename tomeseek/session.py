"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def session(app: str = "tomeseek", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators' plans are tuned for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Look-ups of up to 500 terms reach the Parquet reader as such, not as a range.
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "500")
        # Tables bucketed by doc_id then meet on (doc_id, chunk) without a shuffle.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a new folder under /tmp; a
    cluster has to name one, as a folder on one machine would be lost with it.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/tomeseek/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Cuts the lineage, so a lost executor costs a re-read and not a re-run, and a
    result used several times is computed once.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
