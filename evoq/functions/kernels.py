"""Arrow kernels: batched numpy for the four steps that column expressions cannot do at speed.

Each takes whole batches of signal arrays, works on all rows of one length at once, and gives back plain arrays;
everything before and after (windows, bands, sums, fits, joins) is Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  # rows worked on at once, to stay in cache


def _blocks(signals: pa.Array, *keys: pa.Array):
    """Yield (row numbers, matrix, key) for rows of equal length and equal keys; null and empty rows are left out."""
    lengths = np.asarray(signals.value_lengths().fill_null(0))
    values = np.asarray(signals.flatten(), dtype=np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    columns = [lengths.astype(float)] + [np.asarray(k.cast(pa.float64()).fill_null(np.nan)) for k in keys]
    table = np.column_stack(columns)
    usable = (lengths > 0) & ~np.isnan(table).any(axis=1)
    for key in np.unique(table[usable], axis=0):
        rows = np.flatnonzero(usable & (table == key).all(axis=1))
        for at in range(0, len(rows), BLOCK):
            part = rows[at:at + BLOCK]
            yield part, values[starts[part][:, None] + np.arange(int(key[0]))], key[1:]


def _lists(results: list) -> pa.Array:
    return pa.array(results, type=pa.list_(pa.float64()))


# ---------------------------------------------------------------- Welch spectrum

def welch_power(x: np.ndarray, fs: float, segment: int) -> np.ndarray:
    """One-sided density by the mean periodogram of half-overlapping Hann segments, each freed of its mean."""
    n = min(x.shape[1], segment)
    pieces = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, ::n - n // 2]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    pieces = (pieces - pieces.mean(axis=2, keepdims=True)) * taper
    power = (np.abs(np.fft.rfft(pieces, axis=2)) ** 2).mean(axis=1) / (fs * (taper ** 2).sum())
    doubled = slice(1, -1) if n % 2 == 0 else slice(1, None)
    power[:, doubled] *= 2
    return power


def welch(signal: Column, sfreq: Column, segment: int) -> Column:
    @F.arrow_udf("array<double>")
    def kernel(signals: pa.Array, rates: pa.Array) -> pa.Array:
        out = [None] * len(signals)
        for rows, x, (fs,) in _blocks(signals, rates):
            for row, power in zip(rows, welch_power(x, fs, segment)):
                out[row] = power
        return _lists(out)

    return kernel(signal, sfreq)


# ---------------------------------------------------------------- band-pass and phase

def butterworth_band(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital band-pass coefficients; edges as shares of the Nyquist rate."""
    w1, w2 = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(prototype ** 2 - centre ** 2 + 0j)
    poles = np.concatenate((prototype + root, prototype - root))
    gain = (width ** order * 4.0 ** order / np.prod(4 - poles)).real
    zeros = np.concatenate((np.ones(order), -np.ones(order)))
    return gain * np.poly(zeros).real, np.poly((4 + poles) / (4 - poles)).real


def _steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Delay-line content for which a unit step passes without a transient."""
    n = len(a) - 1
    shift = np.eye(n, k=1)
    shift[:, 0] -= a[1:]
    return np.linalg.solve(np.eye(n) - shift, b[1:] - a[1:] * b[0])


def _run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter every row, started in the steady state of its first sample."""
    line = np.outer(_steady_state(b, a), x[:, 0])
    y = np.empty_like(x.T)
    for i, sample in enumerate(x.T):
        y[i] = b[0] * sample + line[0]
        line[:-1] = line[1:]
        line[-1] = 0.0
        line += b[1:, None] * sample - a[1:, None] * y[i]
    return y.T


def zero_phase(x: np.ndarray, fs: float, band: tuple[float, float], order: int) -> np.ndarray | None:
    """Forward and backward pass over rows prolonged by odd reflection; None where a row is too short for it."""
    half = fs / 2
    b, a = butterworth_band(order, max(band[0] / half, 1e-4), min(band[1] / half, 0.999))
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        return None
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2:-pad - 2:-1]
    y = _run_filter(b, a, np.hstack((left, x, right)))
    y = _run_filter(b, a, y[:, ::-1])[:, ::-1]
    return y[:, pad:-pad]


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1:(n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1)


def band_pass(signal: Column, sfreq: Column, band: tuple[float, float], order: int = 4) -> Column:
    @F.arrow_udf("array<double>")
    def kernel(signals: pa.Array, rates: pa.Array) -> pa.Array:
        out = [None] * len(signals)
        for rows, x, (fs,) in _blocks(signals, rates):
            y = zero_phase(x, fs, band, order)
            if y is not None:
                for row, values in zip(rows, y):
                    out[row] = values
        return _lists(out)

    return kernel(signal, sfreq)


def unit_phasors(signal: Column) -> Column:
    """Cosine and sine of the analytic phase, one array each; phase 0 where the magnitude is 0."""
    @F.arrow_udf("cos array<double>, sin array<double>")
    def kernel(signals: pa.Array) -> pa.Array:
        cosines, sines = [None] * len(signals), [None] * len(signals)
        for rows, x, _ in _blocks(signals):
            z = analytic(x)
            size = np.abs(z)
            unit = np.divide(z, size, out=np.ones_like(z), where=size > 0)
            for row, c, s in zip(rows, unit.real, unit.imag):
                cosines[row], sines[row] = c, s
        return pa.StructArray.from_arrays([_lists(cosines), _lists(sines)], names=["cos", "sin"])

    return kernel(signal)


# ---------------------------------------------------------------- complexity

def template_matches(x: np.ndarray, tolerance: float, m: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of templates of m and of m + 1 samples closer than tolerance * std in every sample."""
    radius = tolerance * x.std(axis=1, keepdims=True)
    length = x.shape[1]
    short = np.zeros(len(x), dtype=np.int64)
    long = np.zeros(len(x), dtype=np.int64)
    for lag in range(1, length - m):
        near = np.abs(x[:, lag:] - x[:, :-lag]) < radius
        count = length - m - lag
        both = near[:, :count].copy()
        for j in range(1, m):
            both &= near[:, j:j + count]
        short += both.sum(axis=1)
        long += (both & near[:, m:m + count]).sum(axis=1)
    return short, long


def match_counts(signal: Column, tolerance: float) -> Column:
    @F.arrow_udf("short bigint, long bigint")
    def kernel(signals: pa.Array) -> pa.Array:
        short, long = [None] * len(signals), [None] * len(signals)
        for rows, x, _ in _blocks(signals):
            for row, b, a in zip(rows, *template_matches(x, tolerance)):
                short[row], long[row] = int(b), int(a)
        return pa.StructArray.from_arrays(
            [pa.array(short, pa.int64()), pa.array(long, pa.int64())], names=["short", "long"])

    return kernel(signal)


def box_sizes(length: int) -> list[int]:
    """Geometric from 4 to a tenth of the length, ratio 1.2, whole and distinct."""
    steps = int(np.floor(np.log(0.1 * length / 4) / np.log(1.2))) if length >= 40 else -1
    return sorted({int(4 * 1.2 ** i) for i in range(steps + 1)} | {4})


def box_fluctuation(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Root mean square of the summed signal around the line of each box, per box size."""
    walk = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    out = np.full((len(x), len(sizes)), np.nan)
    for at, n in enumerate(sizes):
        if n > x.shape[1]:
            continue
        boxes = walk[:, :x.shape[1] // n * n].reshape(len(x), -1, n)
        boxes = boxes - boxes.mean(axis=2, keepdims=True)
        ramp = np.arange(n) - (n - 1) / 2
        rest = boxes - (boxes @ ramp / (ramp @ ramp))[:, :, None] * ramp
        out[:, at] = np.sqrt((rest ** 2).mean(axis=(1, 2)))
    return out


def fluctuations(signal: Column, sizes: tuple[int, ...] | None) -> Column:
    """Box sizes and fluctuation per size, both in natural logs; sizes without fluctuation are left out."""
    @F.arrow_udf("size array<double>, value array<double>")
    def kernel(signals: pa.Array) -> pa.Array:
        log_size, log_value = [None] * len(signals), [None] * len(signals)
        for rows, x, _ in _blocks(signals):
            chosen = list(sizes) if sizes else box_sizes(x.shape[1])
            for row, values in zip(rows, box_fluctuation(x, chosen)):
                kept = values > 0
                log_size[row] = np.log(np.array(chosen, dtype=float)[kept])
                log_value[row] = np.log(values[kept])
        return pa.StructArray.from_arrays([_lists(log_size), _lists(log_value)], names=["size", "value"])

    return kernel(signal)
