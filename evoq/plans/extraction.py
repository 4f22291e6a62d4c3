"""From stored files to the feature table: manifest, headers and signal data to one row per epoch, and a reject per file left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.config import SignalSpec
from evoq.operators import channels
from evoq.operators.phase import pair_channels
from evoq.plans.features import feature_table
from evoq.session import pin, scratch_path
from evoq.sources import manifest as objects
from evoq.sources import signals

HEADER = {"nbchan": "int", "pnts": "int", "trials": "int", "srate": "double", "xmin": "double", "times_ms": "array<double>",
          "channels": "array<string>", "data": "array<double>", "dims": "array<int>"}
OWNER = ["dataset", "subject", "file"]


def _declared(headers: DataFrame) -> DataFrame:
    """The header fields, NULL where the table lacks one."""
    have = set(headers.columns)
    return headers.select(F.col("key").alias("file"), F.lit(True).alias("has_header"), *[
        (F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in HEADER.items()])


def judged_files(manifest: DataFrame, headers: DataFrame, spec: SignalSpec = SignalSpec(),
                 derivative: str = objects.LABEL_DERIVATIVE) -> DataFrame:
    """One row per ``.set`` file of the derivative: its header without the data, its ``times``, the key of its ``block`` (the ``.fdt`` object
    of the same stem, NULL if the data are in the file), the channel indexes that features need (``wanted``), and
    ``stage`` and ``reason`` of the first thing that is wrong with it, NULL for a good file.

    Everything is told from the manifest and the headers; no signal is read for it.
    """
    files = objects.signal_files(manifest, derivative).select("dataset", "subject", F.col("key").alias("file"), "stem").dropDuplicates(["file"])
    blocks = manifest.where(F.col("key").endswith(".fdt")).select("stem", F.col("key").alias("block"), F.col("size").alias("length"))
    rows = signals.with_times(files.join(blocks, "stem", "left").join(_declared(headers), "file", "left"))
    names = {n.lower() for n in (*spec.vertex_priority, *pair_channels(spec))}
    known = F.transform("channels", lambda c: F.coalesce(F.lower(c), F.lit("unknown")))
    ch, tm = signals.axes_of(F.col("dims"), F.col("nbchan"), F.col("pnts"))
    inside, cells = F.col("data").isNotNull(), F.aggregate("dims", F.lit(1).cast("bigint"), lambda n, d: n * d)
    size = F.format_string("%d bytes for %d x %d x %d values of 4", "length", "nbchan", "pnts", F.coalesce("trials", F.lit(1)))
    tests: list[tuple[Column, str, Column]] = [
        (F.col("has_header").isNull(), "header", F.lit("no header")),
        (~inside & F.col("block").isNull(), "block", F.lit("no signal data")),
        (F.col("nbchan").isNull() | F.col("pnts").isNull(), "block shape", F.lit("no channel or sample count")),
        (~inside & ~F.coalesce(signals.block_fits(), F.lit(False)), "block size", size),
        (inside & (ch.isNull() | tm.isNull()), "axes", F.format_string("no axes of %d channels and %d samples", "nbchan", "pnts")),
        (inside & ~F.coalesce(F.size("data") == cells, F.lit(False)), "block size", F.lit("data differ from their axes")),
        (F.size("channels") != F.col("nbchan"), "shape", F.lit("channel count differs from names")),
        (F.col("times").isNull(), "times", F.lit("no time axis")),
        (F.size("times") != F.col("pnts"), "shape", F.lit("sample count differs from time axis")),
        (~F.coalesce(F.arrays_overlap(known, F.array(*[F.lit(n.lower()) for n in spec.vertex_priority])), F.lit(False)), "channels",
         F.lit("no vertex channel"))]
    first = reduce(lambda rest, t: F.when(t[0], F.struct(F.lit(t[1]).alias("stage"), t[2].alias("reason"))).otherwise(rest), reversed(tests),
                   F.lit(None).cast("struct<stage: string, reason: string>"))
    wanted = F.filter(F.transform(known, lambda c, i: F.when(c.isin(sorted(names)), i)), lambda i: i.isNotNull())
    return rows.withColumns({"wanted": wanted, "_wrong": first, "inside": inside}).select(
        *OWNER, "block", "length", "inside", "nbchan", "pnts", "trials", "srate", "channels", "times", "wanted", "_wrong.stage", "_wrong.reason")


def file_epochs(good: DataFrame, headers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Epochs of good files: ``dataset, subject, file, epoch, channel_idx, channel, sfreq, t0, times, n_times, signal`` of the wanted channels.

    ``blocks`` has ``key, content``. The table of good files is short and goes to the blocks; what a row needs of it goes through the
    decoding with it, so no signal is shuffled.
    """
    own = [*OWNER, "channels", "srate", "times"]
    stored = blocks.select(F.col("key").alias("path"), "content").join(good.where("not inside").withColumnRenamed("block", "path"), "path")
    # A sibling that changed since it was listed must not shift the samples: the size is compared with the content.
    outside = signals.decode_float_blocks(stored.withColumn("length", F.length("content").cast("bigint")), [*own, "pnts"], "wanted")
    data = _declared(headers).select("file", "data", "dims").where(F.col("data").isNotNull())
    within = signals.turn_tensors(data.join(good.where("inside"), "file"), [*own, "pnts", "wanted"])
    rows = outside.drop("path").unionByName(within.where(F.array_contains("wanted", F.col("channel_idx"))).drop("wanted"))
    return rows.select(*OWNER, "epoch", "channel_idx", F.coalesce(F.get("channels", F.col("channel_idx")), F.lit("unknown")).alias("channel"),
                       F.col("srate").alias("sfreq"), F.get("times", F.lit(0)).alias("t0"), "times", F.col("pnts").alias("n_times"), "signal")


def extract_files(manifest: DataFrame, headers: DataFrame, blocks: DataFrame, labels: DataFrame | None = None,
                  spec: SignalSpec = SignalSpec(), store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The feature table of all good files (with ``file`` in its key) and a reject (``dataset, subject, file, stage, reason``) per other file.

    * ``manifest``: objects with the parts of their keys and sizes. ``headers``: per ``.set`` file ``key`` and the fields of ``HEADER``, any of
      which may be absent; ``data`` with ``dims`` if the file holds its signals itself. ``blocks``: ``key, content`` of the siblings.
    * Epochs count from 0, labels from 1; labels with a ``file`` go to that file alone.

    Blocks are decoded once, for the channels that features use, into an epoch store (``store``, by default in the shared folder), from
    which all features are read. Labels of files that give no features are left out before they are grouped.
    """
    files = pin(judged_files(manifest, headers, spec))
    epochs = file_epochs(files.where("reason is null"), headers, blocks)
    if labels is not None:
        owner = [c for c in OWNER if c in labels.columns]
        labels = labels.join(files.where("reason is null").select(*owner), owner, "left_semi")
    store = store or scratch_path(manifest.sparkSession, "epochs")
    signals.write_epochs(epochs, store)
    table = feature_table(signals.read_epochs(manifest.sparkSession, store), labels, spec)
    return table, files.where("reason is not null").select(*OWNER, "stage", "reason")


def extraction(features: DataFrame, rejects: DataFrame) -> DataFrame:
    """Both results as one table: rejects have their stage and reason, and no epoch."""
    return features.unionByName(rejects, allowMissingColumns=True)


def montage_of(files: DataFrame) -> DataFrame:
    """The channels of each file, from the headers alone."""
    return channels.channel_table(files.select(*OWNER, F.posexplode("channels").alias("channel_idx", "channel")))
