"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A join side is broadcast only if its stored or measured size is under this bound; else both sides are shuffled. Stored
# columns unpack to several times their size in memory.
BROADCAST_BOUND = "16m"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": BROADCAST_BOUND,
    "spark.sql.autoBroadcastJoinThreshold": BROADCAST_BOUND,
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A signal row is some 12 KB, so a batch stays near 25 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.session.timeZone": "UTC",
}

# Anonymous reads of a public bucket through the s3a file system.
ANONYMOUS_STORE = {
    "spark.hadoop.fs.s3a.aws.credentials.provider":
        "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider",
    "spark.hadoop.fs.s3a.connection.maximum": "200",
}


def build_session(app: str = "evoq", master: str | None = None, anonymous_store: bool = False,
                  **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if anonymous_store:
        settings.update(ANONYMOUS_STORE)
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Only in local mode, where driver and executors are one machine, does a temporary folder stand in for it.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        _local_folder = folder = _local_folder or tempfile.mkdtemp(prefix="evoq-")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Spark removes the shuffle files of a query when it ends, not only when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame) -> DataFrame:
    """Write a table (not signals) to the shared folder and read it from there.

    Every branch of a plan then reads the same rows however often a lost task is run again, and the planner knows
    the size: joined to a large table, a small one is broadcast and the large one is not shuffled at all, while one
    beyond the bound is joined by shuffling. An aggregate's size is known only when the large side has been
    shuffled already. The shuffle files of the write are removed with its end, as the table is read from the folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pin")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
