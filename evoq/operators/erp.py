"""Windows of an epoch and the peaks of the evoked response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.config import SignalSpec
from evoq.functions.arrays import Axis, cut, first_extreme, mean_of, without_helpers
from evoq.functions.numbers import missing_as_null


def with_windows(df: DataFrame, spec: SignalSpec, *names: str) -> DataFrame:
    """Adds ``_<name>_first`` and ``_<name>_count`` for the named windows (all of them by default)."""
    return Axis.of(df).with_bounds(df, {n: spec.windows[n] for n in names or spec.windows})


def samples(name: str) -> Column:
    """The samples of a window whose bounds are there."""
    return cut(F.col("signal"), F.col(f"_{name}_first"), F.col(f"_{name}_count"))


def enough(name: str, least: int) -> Column:
    """The samples of a window, NULL where there are fewer than ``least``."""
    return F.when(F.col(f"_{name}_count") >= least, samples(name))


def baseline_mean() -> Column:
    """Mean of the baseline's samples: 0 for a window without samples, NULL where no sample of it is a number."""
    return F.when(F.col("_baseline_count") > 0, mean_of(samples("baseline"))).otherwise(0.0)


def with_peaks(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """N2 (least) and P2 (largest) amplitude against the baseline mean, their times, and the difference.

    All NULL where either window holds no sample.
    """
    axis = Axis.of(df)
    out = with_windows(df, spec, "baseline", "n2", "p2")
    out = out.withColumns({"_base": baseline_mean(), "_n2": samples("n2"), "_p2": samples("p2")})
    both = (F.col("_n2_count") > 0) & (F.col("_p2_count") > 0)
    out = out.withColumns({f"_{n}_at": F.when(both, first_extreme(F.col(f"_{n}"), largest=n == "p2"))
                           for n in ("n2", "p2")})
    peaks = {}
    for n in ("n2", "p2"):
        peaks[f"{n}_amp"] = missing_as_null(F.expr(f"get(_{n}, _{n}_at) - _base"))
        peaks[f"{n}_lat"] = F.expr(axis.time(f"_{n}_first + _{n}_at"))
    out = out.withColumns(peaks).withColumn("n2p2_amp", F.col("p2_amp") - F.col("n2_amp"))
    return without_helpers(out, df.columns)


def subtract_baseline(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    out = with_windows(df, spec, "baseline").withColumn("_base", baseline_mean())
    level = F.array_repeat(F.col("_base"), F.size("signal"))
    out = out.withColumn("signal", F.zip_with("signal", level, lambda v, b: v - b))
    return without_helpers(out, df.columns)
