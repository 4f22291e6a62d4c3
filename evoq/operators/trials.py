"""Labels by epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoq.config import KEY, epoch_key


def first_event_per_epoch(labels: DataFrame, values: tuple[str, ...] = ("rating", "laser_power")) -> DataFrame:
    """The values of the event that arrived first in each epoch; events without an epoch drop out.

    Labels count epochs from 1, the result counts them from 0 as the signals do. ``event_pos`` names an event within its
    file; all values come from one event, of equal places the one with the least values. The minimum is combined on
    the map side, so no epoch or subject is ever gathered.
    """
    first = F.min(F.struct("event_pos", *values)).alias("_first")
    counted = labels.where(F.col("epoch").isNotNull()).withColumn("epoch", F.col("epoch") - 1)
    key = epoch_key(labels)
    return counted.groupBy(*key).agg(first).select(*key, *[F.col(f"_first.{v}").alias(v) for v in values])


def epoch_spine(files: DataFrame) -> DataFrame:
    """Rows 0 .. n_epochs - 1 of each file."""
    last = F.greatest("n_epochs", F.lit(1)).cast("int") - 1
    return files.where(F.col("n_epochs") > 0).select(
        "dataset", "subject", F.explode(F.sequence(F.lit(0), last)).alias("epoch"))


def reindex(by_epoch: DataFrame, files: DataFrame) -> DataFrame:
    """One row per epoch of each file, NULL where the label table has none."""
    return epoch_spine(files).join(by_epoch, list(KEY), "left")


def attach_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(first_event_per_epoch(labels), epoch_key(labels), "left")
