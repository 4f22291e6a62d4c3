"""Spectral features. Each spectrum is made once per epoch and window; bands are sums over its bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoq.config import SignalSpec, Span, epoch_key
from evoq.functions.arrays import entropy_bits, without_helpers
from evoq.functions.kernels import welch
from evoq.functions.numbers import band_label, capped_high, missing_as_null, percent_change
from evoq.operators.erp import enough, with_windows


def with_spectra(df: DataFrame, spec: SignalSpec, segments: dict[str, int]) -> DataFrame:
    """Adds ``_<window>_psd`` and ``_<window>_n``, the segment length used; both NULL for too few samples."""
    missing = {w: s for w, s in segments.items() if f"_{w}_psd" not in df.columns}
    out = with_windows(df, spec, *missing) if missing else df
    lengths = {f"_{w}_n": F.when(F.col(f"_{w}_count") >= spec.min_samples, F.least(F.col(f"_{w}_count"), F.lit(s)))
               for w, s in missing.items()}
    return out.withColumns({**lengths, **{f"_{w}_psd": welch(enough(w, spec.min_samples), F.col("sfreq"), s)
                                          for w, s in missing.items()}})


def segment_rows(df: DataFrame, spec: SignalSpec = SignalSpec(), window: str = "psd") -> DataFrame:
    """``s, i, v`` of the segments of the spectrum that overlap by half, one row per sample of each, in the task that read the signal."""
    n, key = spec.psd_segment, epoch_key(df)
    cut = with_windows(df, spec, window).select(*key, enough(window, spec.psd_segment).alias("_x"))
    starts = F.sequence(F.lit(0), F.size("_x") - n, F.lit(n - n // 2))
    parts = cut.where("_x is not null").withColumn("_parts", F.transform(starts, lambda a: F.slice("_x", a + 1, F.lit(n))))
    return parts.select(*key, F.posexplode("_parts").alias("s", "_part")).select(*key, "s", F.posexplode("_part").alias("i", "v"))


def basis_table(spark: SparkSession, n: int) -> DataFrame:
    """``k, i, c, s``: cosine and sine of every bin of ``n`` samples; its size depends on ``n`` alone."""
    turns = spark.range(n // 2 + 1).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    angle = F.col("k") * F.col("i") * (2 * math.pi / n)
    return turns.select("k", "i", F.cos(angle).alias("c"), F.sin(angle).alias("s"))


def basis_sums(samples: DataFrame, key: list[str], n: int) -> DataFrame:
    """Fourier sums ``k, re, im`` of samples ``i, v`` per key, for all bins: a join with the basis, sums combined before the shuffle."""
    basis = F.broadcast(basis_table(samples.sparkSession, n))  # n / 2 + 1 bins of n samples
    return samples.join(basis, "i").groupBy(*key, "k").agg(
        F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"))


def with_psd(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """The spectrum shared by the band powers and the spectral entropy."""
    return with_spectra(df, spec, {"psd": spec.psd_segment})


def with_powers(df: DataFrame, powers: dict[str, tuple[str, float, str]]) -> DataFrame:
    """Adds a power per entry ``name: (window, low, high)``, ``high`` in SQL: the trapezoid over the bins with
    low <= f <= high, 0 for a single bin, NULL for none."""
    steps = {f"_{w}_df": F.expr(f"1D / (_{w}_n * (1D / sfreq))") for w in {w for w, _, _ in powers.values()}}
    guess, ends, bins, values = {}, {}, {}, {}
    for name, (w, low, high) in powers.items():
        psd, step, low = f"_{w}_psd", f"_{w}_df", f"{float(low)!r}D"
        c, f, i, j, x = (f"_{name}_{part}" for part in ("c", "f", "i", "j", "bins"))
        guess[c] = F.expr(f"cast(ceil({low} / {step}) AS int)")
        guess[f] = F.expr(f"cast(floor({high} / {step}) AS int)")
        # The bin frequencies themselves settle which bins are inside.
        ends[i] = F.expr(f"greatest(0, CASE WHEN ({c} - 1) * {step} >= {low} THEN {c} - 1 "
                         f"WHEN {c} * {step} >= {low} THEN {c} ELSE {c} + 1 END)")
        ends[j] = F.expr(f"least(size({psd}) - 1, CASE WHEN ({f} + 1) * {step} <= {high} THEN {f} + 1 "
                         f"WHEN {f} * {step} <= {high} THEN {f} ELSE {f} - 1 END)")
        bins[x] = F.expr(f"CASE WHEN {j} >= {i} THEN slice({psd}, {i} + 1, {j} - {i} + 1) END")
        values[name] = missing_as_null(F.expr(
            f"{step} * (aggregate({x}, 0D, (acc, v) -> acc + v) - (get({x}, 0) + element_at({x}, -1)) / 2)"))
    return df.withColumns(steps).withColumns(guess).withColumns(ends).withColumns(bins).withColumns(values)


def with_band_powers(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """``psd_<band>`` over the spectral window, the upper edges capped below the Nyquist rate."""
    out = with_powers(with_psd(df, spec), {
        f"psd_{b}": ("psd", low, _cap(high, spec)) for b, (low, high) in spec.bands.items()})
    return without_helpers(out, df.columns)


def _cap(high: float, spec: SignalSpec) -> str:
    return f"least({float(high)!r}D, sfreq / 2 - {float(spec.nyquist_margin)!r}D)"


def with_gamma(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """Gamma power after the stimulus and the band used; a short window reports the band without the cap."""
    low, high = spec.bands["gamma"]
    out = with_spectra(df, spec, {"gamma": spec.psd_segment})
    out = with_powers(out, {"gamma_power": ("gamma", low, _cap(high, spec))})
    used = F.when(F.col("_gamma_n").isNull(), F.lit(high)).otherwise(capped_high(high, F.col("sfreq"), spec.nyquist_margin))
    return without_helpers(out.withColumn("gamma_band_hz", band_label(low, used)), df.columns)


def with_erd(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """Drop of alpha and beta power from baseline to task, in percent of the baseline."""
    bands: dict[str, Span] = {b: spec.bands[b] for b in ("alpha", "beta")}
    out = with_spectra(df, spec, {"baseline": spec.erd_segment, "erd_task": spec.erd_segment})
    out = with_powers(out, {f"_{b}_{w}": (w, low, f"{high!r}D") for b, (low, high) in bands.items()
                            for w in ("baseline", "erd_task")})
    out = out.withColumns({f"{b}_erd_pct": percent_change(F.col(f"_{b}_baseline"), F.col(f"_{b}_erd_task")) for b in bands})
    return without_helpers(out, df.columns)


def with_spectral_entropy(df: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """Entropy of the spectrum over log2 of its bin count; the rate cancels out, so the same spectrum serves."""
    psd = F.col("_psd_psd")
    out = with_psd(df, spec).withColumn(
        "spectral_entropy", missing_as_null(F.try_divide(entropy_bits(psd), F.log2(F.size(psd)))))
    return without_helpers(out, df.columns)
