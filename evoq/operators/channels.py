"""Channel choice by name, upper and lower case alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoq.config import PLV_PAIRS, VERTEX_PRIORITY, file_key, pairs_table, priority_table
from evoq.session import pin


def labelled(rows: DataFrame) -> DataFrame:
    """Rows whose ``channel`` has a name; one without a label is ``unknown``."""
    return rows.withColumn("channel", F.coalesce("channel", F.lit("unknown")))


def channel_table(epochs: DataFrame) -> DataFrame:
    """The channels of each file, named by ``labelled``."""
    return labelled(epochs).select(*file_key(epochs), "channel_idx", "channel").distinct()


def named(rows: DataFrame, names) -> DataFrame:
    """Rows of the named channels; the stored ``channel_key``, where there is one, lets the scan skip the others."""
    key = F.col("channel_key") if "channel_key" in rows.columns else F.lower("channel")
    return rows.where(key.isin(sorted({n.lower() for n in names})))


def pick_vertex(channels: DataFrame, priority: tuple[str, ...] = VERTEX_PRIORITY) -> DataFrame:
    """Per file the first priority name present; of equal names the last index. Files without one drop out."""
    table = F.broadcast(priority_table(channels.sparkSession, priority))  # fixed: one row per priority name
    hits = channels.join(table, F.lower(channels["channel"]) == table["name"])
    best = F.min(F.struct("priority", (-F.col("channel_idx")).alias("last"), "channel")).alias("best")
    return hits.groupBy(*file_key(channels)).agg(best).select(
        *file_key(channels), (-F.col("best.last")).alias("channel_idx"), F.col("best.channel").alias("vertex_channel"))


def vertex_epochs(epochs: DataFrame, priority: tuple[str, ...] = VERTEX_PRIORITY) -> DataFrame:
    """The signal of the chosen channel of each epoch; the name filter reaches the scan before the join.

    The choice (a short row per file, made without reading signals) is pinned, so that it goes to the signals.
    """
    candidates = named(epochs, priority)
    choice = pin(pick_vertex(channel_table(candidates), priority))
    return candidates.join(choice, [*file_key(epochs), "channel_idx"])


def last_index_of_name(channels: DataFrame) -> DataFrame:
    return channels.groupBy(*file_key(channels), F.lower("channel").alias("name")).agg(F.max("channel_idx").alias("channel_idx"))


def resolve_pairs(channels: DataFrame, pairs=PLV_PAIRS) -> DataFrame:
    """Per file the pairs with both ends present, with the index of each end."""
    names, file = last_index_of_name(named(channels, {n for p in pairs for n in p})), file_key(channels)
    table = F.broadcast(pairs_table(channels.sparkSession, pairs))  # fixed: one row per pair
    a = names.join(table, F.col("name") == F.col("name_a")).select(*file, "pair", F.col("channel_idx").alias("idx_a"))
    b = names.join(table, F.col("name") == F.col("name_b")).select(*file, "pair", F.col("channel_idx").alias("idx_b"))
    return a.join(b, [*file, "pair"])


def files_with(channels: DataFrame, files: DataFrame, name: str = "Cz") -> DataFrame:
    """Files whose channel list holds exactly this name."""
    return files.join(channels.where(F.col("channel") == name), file_key(channels), "left_semi")
