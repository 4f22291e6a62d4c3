"""JSON sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoq.functions import text
from evoq.session import pin


def read_sidecars(spark: SparkSession, path: str, glob: str = "*_events.json") -> DataFrame:
    """Key and text of each sidecar; bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("key"), F.regexp_extract("path", "(ds[0-9]+)/", 1).alias("dataset"),
                        text.decode_text(F.col("content")).alias("content"))


def parsed(sidecars: DataFrame) -> DataFrame:
    """The text as a VARIANT, NULL where it is not JSON."""
    return sidecars.withColumn("json", text.whole_json(F.col("content")))


def distinct_contents(sidecars: DataFrame) -> DataFrame:
    """Each content once per dataset, under its smallest key. Texts shuffle only as digests."""
    return sidecars.groupBy("dataset", F.sha2("content", 256).alias("digest")).agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("n_copies"))


def first_contents(sidecars: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` distinct contents of each dataset in key order, with a preview of the text."""
    order = Window.partitionBy("dataset").orderBy("key")
    chosen = distinct_contents(sidecars).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return pin(chosen.select("dataset", "key", "nth")).join(sidecars, ["dataset", "key"]) \
        .select("dataset", "nth", "key", text.json_preview(F.col("content")).alias("preview"))
