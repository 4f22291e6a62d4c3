"""Phase locking between channels within one epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoq.config import SignalSpec, epoch_key
from evoq.functions.arrays import without_helpers
from evoq.functions.kernels import band_pass, unit_phasors
from evoq.functions.numbers import missing_as_null, resultant_length
from evoq.operators.channels import named
from evoq.operators.erp import enough, with_windows


def pair_channels(spec: SignalSpec) -> list[str]:
    return sorted({n.lower() for pair in spec.pairs for n in pair})


def with_filtered(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """Zero-phase band-pass of whole epochs; NULL where an epoch is not longer than the filter's padding."""
    return df.withColumn("signal", band_pass(F.col("signal"), F.col("sfreq"), spec.plv_band, spec.filter_order))


def phasors(df: DataFrame, spec: SignalSpec = SignalSpec(), filtered: bool = True) -> DataFrame:
    """``z`` with the cosine and sine of the phase in the locking window; each channel is filtered once."""
    source = with_windows(with_filtered(df, spec) if filtered else df, spec, "plv")
    return without_helpers(source.withColumn("z", unit_phasors(enough("plv", spec.min_samples))), df.columns)


def phase_locking(epochs: DataFrame, spec: SignalSpec = SignalSpec(), filtered: bool = True) -> DataFrame:
    """One ``plv_<a>-<b>`` per pair and epoch, NULL where an end is missing.

    Only the window's phasors of the pairs' channels are shuffled, once, by epoch; the sums then run in place.
    """
    wanted, key = named(epochs, pair_channels(spec)), epoch_key(epochs)
    rows = phasors(wanted, spec, filtered).select(*key, F.lower("channel").alias("name"), "channel_idx", "z")
    ends = pair_channels(spec)
    # Of equal names the last index counts.
    wide = rows.groupBy(*key).agg(*[F.max_by(F.when(F.col("name") == n, F.col("z")),
                                             F.when(F.col("name") == n, F.col("channel_idx"))).alias(n)
                                    for n in ends])
    none = F.array().cast("array<double>")  # a missing end is an empty array: zipping pads it with NULL
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"{n}.{part}"), none).alias(f"{n}_{part}")
                            for n in ends for part in ("cos", "sin")])
    samples = wide.select(*key, F.explode_outer(zipped).alias("s"))
    means = {}
    for a, b in spec.pairs:
        ca, sa, cb, sb = (F.col(f"s.{n}_{p}") for n in (a.lower(), b.lower()) for p in ("cos", "sin"))
        means[f"plv_{a}-{b}"] = (F.avg(ca * cb + sa * sb), F.avg(sa * cb - ca * sb))
    return samples.groupBy(*key).agg(*[missing_as_null(resultant_length(c, s)).alias(name)
                                       for name, (c, s) in means.items()])
