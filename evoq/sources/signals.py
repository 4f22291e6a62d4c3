"""Epoched signals: decode, orient, check and store one row per (dataset, subject, epoch, channel).

Row: ``dataset, subject, epoch INT, channel_idx INT, channel, sfreq, t0, n_times INT, signal ARRAY<DOUBLE>``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from evoq.config import file_key
from evoq.session import pin
from evoq.sources.stores import store_of

DEFAULT_RATE = 1000.0
MOST_TASKS = 20_000
_SIGNAL = StructType().add("epoch", IntegerType()).add("channel_idx", IntegerType()).add("signal", ArrayType(DoubleType()))


def read_float_blocks(spark: SparkSession, path: str, shapes: DataFrame, glob: str = "*.fdt") -> DataFrame:
    """Blocks of a folder with their shapes (``path, nbchan, pnts, trials``), NULL for a block without one.

    The shapes are pinned: known to be small, they go to the blocks, and no block is shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "content").join(pin(shapes), "path", "left")


def block_fits(length="length"):
    return F.col(length) == F.lit(4).cast("bigint") * F.col("nbchan") * F.col("pnts") \
        * F.coalesce(F.col("trials"), F.lit(1))


def decode_float_blocks(blocks: DataFrame, keep: Sequence[str] = (), wanted: str | None = None) -> DataFrame:
    """Little-endian float32, channel fastest, then time, then epoch -> ``path, epoch, channel_idx, signal`` and the columns to ``keep``.

    Blocks whose size does not match their shape are left out (see ``block_rejects``). ``wanted`` names a column with the indexes
    of the channels to decode, all of them without it. Nothing is joined afterwards, so signals need not move.
    """
    kept = len(keep)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                content, channels, times, trials = (batch.column(kept + i)[row] for i in range(1, 5))
                channels, times, trials = channels.as_py(), times.as_py(), trials.as_py()
                chosen = np.arange(channels) if wanted is None else np.array(batch.column(kept + 5)[row].as_py() or [], dtype=int)
                flat = np.frombuffer(content.as_buffer(), dtype="<f4")
                own = [c.slice(row, 1).take(pa.array(np.zeros(len(chosen), "i4"))) for c in batch.columns[:kept + 1]]
                for epoch in range(trials):  # an epoch at a time: the widened copy never exceeds one epoch
                    part = flat[epoch * channels * times:(epoch + 1) * channels * times]
                    yield pa.RecordBatch.from_arrays([
                        *own, pa.array([epoch] * len(chosen), pa.int32()), pa.array(chosen, pa.int32()),
                        _signals(part.reshape(times, channels).T[chosen])], names=names)

    good = blocks.where(block_fits()).select(
        *keep, "path", "content", "nbchan", "pnts", F.coalesce("trials", F.lit(1)).alias("trials"), *([wanted] if wanted else []))
    schema = StructType(good.select(*keep, "path").schema.fields + _SIGNAL.fields)
    names = schema.names
    return good.mapInArrow(decode, schema)


def _signals(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype="i4") * matrix.shape[1]), pa.array(matrix.astype("f8").ravel()))


def axes_of(dims, n_channels, n_times):
    """The axes (1 to 3) of channels and time in a tensor of three lengths, NULL where none fit: (epoch, channel, time) if that
    fits; else the channels' is the first of their number, the time's the first other one of its length."""
    stored = (F.get(dims, F.lit(1)) == n_channels) & (F.get(dims, F.lit(2)) == n_times)
    ch = F.when(F.size(dims) == 3, F.when(stored, 2).otherwise(F.nullif(F.array_position(dims, n_channels).cast("int"), F.lit(0))))
    tm = F.when(stored, 3)
    for axis in (1, 2, 3):
        tm = F.coalesce(tm, F.when((ch != axis) & (F.get(dims, F.lit(axis - 1)) == n_times), axis))
    return ch, F.when(ch.isNotNull(), tm)


def turn_tensors(tensors: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Tensors stored in a row (``data`` flat, last axis fastest, ``dims``, ``nbchan``, ``pnts``) -> ``keep, epoch, channel_idx, signal``.

    Each is turned where it is read (see ``axes_of``); one whose axes or length do not fit is left out.
    """
    kept = len(keep)
    ch, tm = axes_of(F.col("dims"), F.col("nbchan"), F.col("pnts"))
    cells = F.aggregate("dims", F.lit(1).cast("bigint"), lambda n, d: n * d)
    good = tensors.select(*keep, F.col("data").cast("array<double>").alias("data"), "dims", ch.alias("ch"), tm.alias("tm")) \
        .where("ch is not null and tm is not null").where(F.size("data") == cells)
    schema = StructType(good.select(*keep).schema.fields + _SIGNAL.fields)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, dims, channel, time = (batch.column(kept + i)[row] for i in range(4))
                c, t = channel.as_py() - 1, time.as_py() - 1
                cube = data.values.to_numpy(zero_copy_only=False).reshape(dims.as_py()).transpose(3 - c - t, c, t)
                for epoch, matrix in enumerate(cube):
                    own = [x.slice(row, 1).take(pa.array(np.zeros(len(matrix), "i4"))) for x in batch.columns[:kept]]
                    yield pa.RecordBatch.from_arrays([
                        *own, pa.array([epoch] * len(matrix), pa.int32()), pa.array(np.arange(len(matrix)), pa.int32()), _signals(matrix)],
                        names=schema.names)

    return good.mapInArrow(turn, schema)


def block_rejects(blocks: DataFrame) -> DataFrame:
    """Every block that ``decode_float_blocks`` leaves out, with the reason."""
    known = F.col("nbchan").isNotNull() & F.col("pnts").isNotNull()
    size = F.format_string("%d bytes for %d x %d x %d values of 4", "length", "nbchan", "pnts", F.coalesce("trials", F.lit(1)))
    return blocks.where(~F.coalesce(block_fits(), F.lit(False))).select(
        "path", F.when(known, "block size").otherwise("block shape").alias("stage"),
        F.when(known, size).otherwise("no channel or sample count").alias("reason"))


RANGE_BYTES = 32 << 20


def decode_block_ranges(files: DataFrame, keep: Sequence[str] = (), wanted: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What ``decode_float_blocks`` gives, for blocks too large for one row: ``path, length, nbchan, pnts, trials`` without content.

    Ranges of whole epochs, about ``range_bytes`` each, are planned from sizes and shapes; only their short rows are shuffled,
    and the task that gets a range reads its bytes where they are stored. An epoch beyond that size is read in pieces of
    samples, of which only the ``wanted`` channels are kept.
    """
    kept = len(keep)
    size = F.lit(4).cast("bigint") * F.col("nbchan") * F.col("pnts")
    good = files.where(block_fits()).withColumn("trials", F.coalesce("trials", F.lit(1))).where((size > 0) & (F.col("trials") > 0))
    step = F.greatest(F.lit(1), F.least(F.floor(F.lit(range_bytes) / size), F.col("trials"))).cast("int")
    planned = pin(good.select(*keep, "path", "nbchan", "pnts", "trials", step.alias("step"), *([wanted] if wanted else [])))
    ranges = planned.agg(F.sum(F.ceil(F.col("trials") / F.col("step")))).first()[0] or 1
    first = F.explode(F.sequence(F.lit(0), F.col("trials") - 1, F.col("step")))
    dealt = planned.withColumn("first", first).withColumn("count", F.least("step", F.col("trials") - F.col("first"))) \
        .select(*keep, "path", "nbchan", "pnts", "first", "count", *([wanted] if wanted else [])) \
        .repartition(min(int(ranges), MOST_TASKS), "path", "first")
    schema = StructType(dealt.select(*keep, "path").schema.fields + _SIGNAL.fields)
    names = schema.names

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, channels, times, begin, count = (batch.column(kept + i)[row].as_py() for i in range(5))
                chosen = np.arange(channels) if wanted is None else np.array(batch.column(kept + 5)[row].as_py() or [], dtype=int)
                store, place = store_of(path)
                with store.open_input_file(place) as block:
                    for epoch in range(begin, begin + count):
                        matrix = np.empty((len(chosen), times), "<f4")
                        most = max(1, range_bytes // (4 * channels))
                        for low in range(0, times, most):
                            n = min(most, times - low)
                            raw = block.read_at(4 * channels * n, 4 * channels * (epoch * times + low))
                            matrix[:, low:low + n] = np.frombuffer(raw, "<f4").reshape(n, channels)[:, chosen].T
                        most = max(1, (1 << 22) // times)
                        for low in range(0, len(chosen), most):
                            part = chosen[low:low + most]
                            own = [c.slice(row, 1).take(pa.array(np.zeros(len(part), "i4"))) for c in batch.columns[:kept + 1]]
                            yield pa.RecordBatch.from_arrays(
                                [*own, pa.array([epoch] * len(part), pa.int32()), pa.array(part, pa.int32()), _signals(matrix[low:low + most])],
                                names=names)

    return dealt.mapInArrow(decode, schema)


def stored_signals(blocks: DataFrame, keep: Sequence[str] = (), wanted: str | None = None, limit: int = 4 * RANGE_BYTES,
                   range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Signals of the blocks of ``read_float_blocks``, small and large: those above ``limit`` bytes are read by ranges, and their
    content is never loaded as a row, since the scan gets the condition on the length. For rejects see ``block_rejects``."""
    small = decode_float_blocks(blocks.where(F.col("length") <= limit), keep, wanted)
    return small.unionAll(decode_block_ranges(blocks.where(F.col("length") > limit), keep, wanted, range_bytes))


def decode_large_block(spark: SparkSession, path: str, nbchan: int, pnts: int) -> DataFrame:
    """One large block of whole epochs, by ranges: ``epoch, channel_idx, signal``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.lit(nbchan).alias("nbchan"), F.lit(pnts).alias("pnts"))
    trials = (F.col("length") / (4 * nbchan * pnts)).cast("int")
    return decode_block_ranges(files.withColumn("trials", trials)).select("epoch", "channel_idx", "signal")


def gather_signals(samples: DataFrame, key: list[str]) -> DataFrame:
    """Samples (``i, v``) back to one array per key, in sample order; a group is one signal, so its size is bounded."""
    return samples.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")) \
        .select(*key, F.col("s.v").alias("signal"))


def to_samples(epochs: DataFrame, *keep: str) -> DataFrame:
    return epochs.select(*keep, F.posexplode("signal").alias("i", "v"))


def _axis_roles(cells: DataFrame) -> DataFrame:
    """Per file the axes (1 to 3) of channels ``ch`` and time ``tm``, NULL where none fits."""
    key = ["dataset", "subject"]
    lengths = cells.groupBy(*key, "n_channels", "n_times").agg(
        *[(F.max(f"a{i}") + 1).alias(f"l{i}") for i in range(3)])
    axes = F.array("l0", "l1", "l2")
    stored = (F.col("l1") == F.col("n_channels")) & (F.col("l2") == F.col("n_times"))
    found = F.nullif(F.array_position(axes, F.col("n_channels")).cast("int"), F.lit(0))
    others = F.filter(F.array(*map(F.lit, (1, 2, 3))),
                      lambda i: (i != F.col("ch")) & (F.element_at(axes, i) == F.col("n_times")))
    return lengths.withColumn("ch", F.when(stored, 2).otherwise(found)) \
        .withColumn("tm", F.when(stored, 3).otherwise(F.get(others, F.lit(0))))


def orient_rejects(cells: DataFrame) -> DataFrame:
    """Files whose axes fit no roles."""
    return _axis_roles(cells).where("ch is null or tm is null").select(
        "dataset", "subject", F.lit("axes").alias("stage"),
        F.format_string("no axes of %d channels and %d samples", "n_channels", "n_times").alias("reason"))


def orient(cells: DataFrame) -> DataFrame:
    """Give the axes of a tensor stored cell by cell their roles.

    ``cells``: ``dataset, subject, a0, a1, a2, v, n_channels, n_times``. Data whose axes fit as (epoch, channel, time)
    keep that order. Else the channel axis is the first of the length n_channels, the time axis the first other one
    of the length n_times, the epoch axis the one left. Files without such axes are in ``orient_rejects``.
    """
    key = ["dataset", "subject"]
    roles = pin(_axis_roles(cells).where("ch is not null and tm is not null")
                .select(*key, "ch", "tm", (F.lit(6) - F.col("ch") - F.col("tm")).alias("ep")))
    at = F.array("a0", "a1", "a2")
    placed = cells.join(roles, key).select(
        *key, F.element_at(at, F.col("ep")).alias("epoch"), F.element_at(at, F.col("ch")).alias("channel_idx"),
        F.element_at(at, F.col("tm")).alias("i"), "v")
    return gather_signals(placed, [*key, "epoch", "channel_idx"])


def with_times(files: DataFrame) -> DataFrame:
    """Seconds per sample: the stored milliseconds / 1000, else ``xmin + i / srate``; NULL where neither is known.

    ``files``: ``times_ms ARRAY<DOUBLE>, xmin, srate, pnts``.
    """
    rate = F.coalesce(F.col("srate"), F.lit(DEFAULT_RATE))
    rebuilt = F.when(F.col("xmin").isNotNull() & (F.col("pnts") > 0), F.transform(
        F.sequence(F.lit(0), F.greatest(F.coalesce("pnts", F.lit(0)), F.lit(1)) - 1), lambda i: F.col("xmin") + i / rate))
    return files.withColumn("times", F.coalesce(F.transform("times_ms", lambda t: t / 1000.0), rebuilt)) \
        .withColumn("srate", rate)


def time_rejects(files: DataFrame) -> DataFrame:
    """Files of ``with_times`` without a time axis."""
    return files.where(F.col("times").isNull()).select(
        "dataset", "subject", F.lit("times").alias("stage"), F.lit("no time axis").alias("reason"))


def check_shapes(epochs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows by their files' declared shape into good rows and one reject per bad file with the reason.

    A declared file without a row and a file without a declared shape are rejects too.

    ``files``: ``dataset, subject, n_channels, n_times, ndim``; a file is bad as a whole, like one read at once.
    """
    key = file_key(epochs)
    # Distinct channels in two steps, both with partial sums: no set of channels is ever held for a large file.
    channels = epochs.groupBy(*key, "channel_idx").agg(
        F.min(F.size("signal")).alias("shortest"), F.max(F.size("signal")).alias("longest"))
    found = channels.groupBy(*key).agg(F.count(F.lit(1)).alias("found_channels"), F.min("shortest").alias("shortest"),
                                       F.max("longest").alias("longest"))
    reason = F.when(F.coalesce("ndim", F.lit(3)) == 2, F.lit("continuous, not epoched")) \
        .when(F.coalesce("ndim", F.lit(3)) != 3, F.lit("unexpected shape")) \
        .when(F.col("found_channels") != F.col("n_channels"), F.lit("channel count differs from names")) \
        .when((F.col("shortest") != F.col("n_times")) | (F.col("longest") != F.col("n_times")),
              F.lit("sample count differs from time axis"))
    undeclared = F.when(F.col("n_channels").isNull(), F.lit("no declared shape"))
    absent = F.when(F.col("found_channels").isNull(), F.lit("no signals"))
    judged = found.join(files, key, "full").select(*key, F.coalesce(absent, undeclared, reason).alias("reason"))
    # Bad files are few, so taking them out does not shuffle the signals.
    bad = pin(judged.where(F.col("reason").isNotNull()))
    return epochs.join(bad, key, "left_anti"), bad.withColumn("stage", F.lit("shape"))


def scale(epochs: DataFrame, factor: float) -> DataFrame:
    """Unit change of the samples, such as volts to microvolts (1e6)."""
    return epochs.withColumn("signal", F.transform("signal", lambda v: v * factor))


def preview(epochs: DataFrame, seconds: float = 30.0, factor: float = 1e6) -> DataFrame:
    """The first ``seconds`` of each signal, scaled, one row per sample."""
    # `size` bounds the slice; the cut happens before the rows are made.
    head = F.slice("signal", F.lit(1), F.least(F.size("signal"), F.floor(F.col("sfreq") * seconds).cast("int")))
    return epochs.select("dataset", "subject", "epoch", "channel", "sfreq", F.posexplode(head).alias("i", "v")) \
        .select("dataset", "subject", "epoch", "channel", "i", (F.col("i") / F.col("sfreq")).alias("t"),
                (F.col("v") * factor).alias("value"))


def write_epochs(epochs: DataFrame, path: str) -> None:
    """Store the signals, in every file ordered by ``channel_key``, the lower-cased name, in small row groups.

    The features of an epoch need at most eight of up to 64 channels: a filter on ``channel_key`` then skips the row
    groups of the others by their bounds. Nothing is shuffled and no task writes more than one file, which one folder
    per channel would cost.
    """
    epochs.withColumn("channel_key", F.lower("channel")).sortWithinPartitions("channel_key", "dataset", "subject", "epoch") \
        .write.option("parquet.block.size", 16 << 20).parquet(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
