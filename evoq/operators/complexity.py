"""Entropy, fractal and Hjorth measures of the signal in the spectral window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoq.config import SignalSpec, epoch_key
from evoq.functions.arrays import line_slope, without_helpers
from evoq.functions.kernels import fluctuations, match_counts
from evoq.functions.numbers import missing_as_null
from evoq.operators.erp import enough, samples, with_windows


def lagged_rows(df: DataFrame, spec: SignalSpec, lags: int) -> DataFrame:
    """One row per sample with the next ``lags`` samples beside it: x0, x1, .. (NULL past the end), length n."""
    key = epoch_key(df)
    cut_once = with_windows(df, spec, "psd").select(*key, samples("psd").alias("_s"), F.col("_psd_count").alias("n"))
    columns = [f"slice(_s, {k + 1}, greatest(n - {k}, 0)) AS x{k}" for k in range(lags + 1)]
    return cut_once.selectExpr(*key, "n", *columns) \
        .selectExpr(*key, "n", f"posexplode_outer(arrays_zip({', '.join(f'x{k}' for k in range(lags + 1))})) AS (i, r)") \
        .selectExpr(*key, "n", "i", *[f"r.x{k}" for k in range(lags + 1)])


def _pattern_entropy() -> Column:
    """Share of each of the six orders of three neighbours; earlier samples go first among equals."""
    orders = ["x0 <= x1 AND x1 <= x2", "x0 <= x2 AND x2 < x1", "x1 < x0 AND x0 <= x2",
              "x1 <= x2 AND x2 < x0", "x2 < x0 AND x0 <= x1", "x2 < x1 AND x1 < x0"]
    counts = [f"count_if({o})" for o in orders]
    terms = [f"coalesce({c} * log2(nullif({c}, 0)), 0D)" for c in counts]
    n = "count(x2)"
    return F.expr(f"CASE WHEN {n} > 0 THEN (log2({n}) - ({' + '.join(terms)}) / {n}) / log2(6D) END")


def _higuchi(kmax: int) -> Column:
    """Slope of log curve length on log 1/k. The curve of start m at step k leaves out its last increment, as the
    entropy library of the analysis does (its documented value for a straight line is 1.0040)."""
    xs = [math.log(1 / k) for k in range(1, kmax + 1)]
    mean = sum(xs) / kmax
    spread = sum((x - mean) ** 2 for x in xs)
    terms = []
    for k, x in enumerate(xs, 1):
        most = f"(n - i % {k} - 1) div {k}"
        length = f"sum(CASE WHEN i div {k} + 1 < {most} THEN abs(x{k} - x0) * (n - 1) / (({most}) * {k ** 3}) END)"
        terms.append(f"ln({length}) * ({(x - mean) / spread!r}D)")
    # Under kmax + 1 samples some curve has no increment at all.
    return F.expr(f"CASE WHEN max(n) > {kmax} THEN {' + '.join(terms)} END")


def neighbour_features(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """Permutation entropy, Higuchi dimension and Hjorth parameters from one pass of lagged rows.

    The rows of an epoch are made and summed in the task that read it; one short row per epoch is shuffled.
    """
    rows, key = lagged_rows(df, spec, spec.higuchi_kmax), epoch_key(df)
    sums = rows.groupBy(*key).agg(
        _pattern_entropy().alias("perm_entropy"), _higuchi(spec.higuchi_kmax).alias("higuchi_fd"),
        F.expr("var_pop(x0) AS _v0"), F.expr("var_pop(x1 - x0) AS _v1"), F.expr("var_pop(x2 - 2 * x1 + x0) AS _v2"))
    mobility = F.sqrt(F.try_divide(F.col("_v1"), F.col("_v0")))
    return sums.select(
        *key, missing_as_null(F.col("perm_entropy")).alias("perm_entropy"),
        missing_as_null(F.col("higuchi_fd")).alias("higuchi_fd"),
        missing_as_null(mobility).alias("hjorth_mobility"),
        missing_as_null(F.try_divide(F.sqrt(F.try_divide(F.col("_v2"), F.col("_v1"))), mobility))
        .alias("hjorth_complexity"))


def template_pairs(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """``short, long`` per epoch, as the kernel counts them, by a range self-join for epochs too long to compare every lag.

    Templates lie in square cells a radius wide by their first two samples; two that match lie in one cell or in neighbouring ones, so each
    meets only those of its own cell and of half the cells around it. The work follows the matches, and a cell is a join key of its own.
    """
    key = epoch_key(df)
    rows = lagged_rows(df, spec, 2)
    radius = rows.groupBy(*key).agg((F.stddev_pop("x0") * spec.entropy_tolerance).alias("r"))
    # A little wider than the radius, so that rounding cannot part two matches by more than one cell.
    cell = lambda x: F.floor(F.col(x) / (F.col("r") * (1 + 1e-9)))
    placed = rows.where("x2 is not null").join(radius.where("r > 0"), key).withColumns({"cx": cell("x0"), "cy": cell("x1")})
    ahead = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    others = placed.withColumn("d", F.explode(ahead)).select(
        *key, (F.col("cx") - F.col("d.x")).alias("cx"), (F.col("cy") - F.col("d.y")).alias("cy"), ((F.col("d.x") == 0) & (F.col("d.y") == 0)).alias("own"),
        *[F.col(n).alias(f"o{n}") for n in ("i", "x0", "x1", "x2")])
    near = lambda x: F.abs(F.col(x) - F.col(f"o{x}")) < F.col("r")
    met = placed.join(others, [*key, "cx", "cy"]).where((~F.col("own") | (F.col("i") < F.col("oi"))) & near("x0") & near("x1"))
    counts = met.groupBy(*key).agg(F.count(F.lit(1)).alias("short"), F.count_if(near("x2")).alias("long"))
    return df.select(*key).distinct().join(counts, key, "left").na.fill(0, ["short", "long"])


def with_sample_entropy(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """-ln of the share of matching pairs of 2 that also match in the third sample; NULL without matches."""
    out = with_windows(df, spec, "psd").withColumn("_m", match_counts(enough("psd", 4), spec.entropy_tolerance))
    ratio = F.try_divide(F.col("_m.long"), F.col("_m.short"))
    return without_helpers(out.withColumn("sample_entropy", -F.ln(F.when(ratio > 0, ratio))), df.columns)


def cumulative_profile(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """``i, y``: running sums of the differences from the mean over the spectral window; a window is one epoch, so its samples bound it."""
    key = epoch_key(df)
    rows = with_windows(df, spec, "psd").select(*key, F.posexplode(samples("psd")).alias("i", "v"))
    own = Window.partitionBy(*key)
    running = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_d", F.col("v") - F.avg("v").over(own)).select(*key, "i", F.sum("_d").over(running).alias("y"))


def with_dfa(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """Slope of log fluctuation on log box size."""
    out = with_windows(df, spec, "psd").withColumn("_f", fluctuations(enough("psd", spec.min_samples), spec.dfa_sizes))
    out = out.withColumn("dfa", missing_as_null(line_slope(F.col("_f.size"), F.col("_f.value"))))
    return without_helpers(out, df.columns)
