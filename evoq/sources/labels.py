"""Trial labels: one row per event, all fields text until coerced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evoq.functions.numbers import to_number

FIELDS = ["type", "laser_power", "rating", "latency", "epoch", "urevent", "code", "duration"]
NUMERIC = ["laser_power", "rating", "latency", "urevent", "duration"]
SCHEMA = "dataset string, subject string, event_pos bigint, " + ", ".join(f"{f} string" for f in FIELDS)


def read_labels(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Decoded label rows; a field a file lacks is NULL."""
    return spark.read.format(fmt).schema(SCHEMA).option("header", "true").load(path)


def _listed() -> Column:
    return F.coalesce(F.col("events"), F.when(F.col("event").isNotNull(), F.array("event")))


def event_rejects(files: DataFrame) -> DataFrame:
    """Files that give no label row, with the reason: no event field, or one that holds nothing."""
    reason = F.when(_listed().isNull(), "no event field").when(F.size(_listed()) == 0, "no events")
    return files.select("dataset", "subject", F.lit("labels").alias("stage"), reason.alias("reason")).where("reason is not null")


def explode_events(files: DataFrame) -> DataFrame:
    """One row per event of ``events ARRAY<STRUCT>``; a file with one event may hold it as ``event STRUCT``.

    The place in the list is kept as ``event_pos``. Files without an event are in ``event_rejects``.
    """
    listed = _listed()
    rows = files.select("dataset", "subject", F.posexplode(listed).alias("event_pos", "ev"))
    have = rows.schema["ev"].dataType.names
    return rows.select("dataset", "subject", "event_pos", *[
        (F.col(f"ev.{f}").cast("string") if f in have else F.lit(None).cast("string")).alias(f) for f in FIELDS])


def coerce(labels: DataFrame) -> DataFrame:
    """Numbers in the place of text, NULL where the text is not one or beyond its type; the epoch counts from 1, as stored."""
    numbers = {c: to_number(F.col(c)) for c in NUMERIC if c in labels.columns}
    epoch = F.floor(to_number(F.col("epoch"))).try_cast("int")
    return labels.withColumns({**numbers, "epoch": epoch})
