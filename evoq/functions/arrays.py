"""Column expressions over a signal array: no explode, no shuffle, one value per row.

Two rules keep them cheap. A value used more than once is a column of its own, so that it is computed once (Spark
merges projections only where that repeats no work). And no lambda refers to a computed value: it would be computed
again for every element.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.config import Span

NAN = float("nan")


@dataclass(frozen=True)
class Axis:
    """How a row gives the time of sample i: ``t0 + i / sfreq``, or an explicit array of seconds."""

    t0: str = "t0"
    sfreq: str = "sfreq"
    n_times: str = "n_times"
    times: str | None = None

    @classmethod
    def of(cls, df: DataFrame) -> "Axis":
        return cls(times="times" if "times" in df.columns else None)

    def time(self, index: str) -> str:
        """SQL for the time of a sample."""
        return f"get({self.times}, {index})" if self.times else f"({self.t0} + ({index}) / {self.sfreq})"

    def with_bounds(self, df: DataFrame, spans: dict[str, Span]) -> DataFrame:
        """Adds ``_<name>_first`` and ``_<name>_count`` of the samples with low <= t <= high, by exact comparison
        of the times. Names that are there already are left alone."""
        have = set(df.columns)
        guess, ends, count = {}, {}, {}
        for n, (low, high) in spans.items():
            if f"_{n}_first" in have:
                continue
            low, high = f"({float(low)!r}D)", f"({float(high)!r}D)"
            if self.times:
                ends[f"_{n}_first"] = F.expr(f"size(filter({self.times}, t -> t < {low}))")
                count[f"_{n}_count"] = F.expr(f"size(filter({self.times}, t -> t >= {low} AND t <= {high}))")
                continue
            c, f = f"_{n}_c", f"_{n}_f"
            guess[c] = F.expr(f"cast(ceil(({low} - {self.t0}) * {self.sfreq}) AS int)")
            guess[f] = F.expr(f"cast(floor(({high} - {self.t0}) * {self.sfreq}) AS int)")
            # The closed form may be one sample off in the last bit; the comparisons settle it.
            ends[f"_{n}_first"] = F.expr(
                f"greatest(0, CASE WHEN {self.time(c + ' - 1')} >= {low} THEN {c} - 1 "
                f"WHEN {self.time(c)} >= {low} THEN {c} ELSE {c} + 1 END)")
            ends[f"_{n}_last"] = F.expr(
                f"least({self.n_times} - 1, CASE WHEN {self.time(f + ' + 1')} <= {high} THEN {f} + 1 "
                f"WHEN {self.time(f)} <= {high} THEN {f} ELSE {f} - 1 END)")
            count[f"_{n}_count"] = F.expr(f"greatest(_{n}_last - _{n}_first + 1, 0)")
        for step in (guess, ends, count):
            df = df.withColumns(step) if step else df
        return df.drop(*guess, *[e for e in ends if e.endswith("_last")])


def without_helpers(df: DataFrame, kept: list[str] = ()) -> DataFrame:
    """Drop the columns that start with an underscore, but for those named."""
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in kept])


def cut(signal: Column, first: Column, count: Column) -> Column:
    return F.slice(signal, first + 1, count)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean_of(values: Column) -> Column:
    """Mean over the samples that are not NaN; NULL where none is left."""
    kept = F.filter(values, lambda v: ~F.isnan(v))
    return F.try_divide(total(kept), F.size(kept))


def first_extreme(values: Column, largest: bool) -> Column:
    """Zero-based index of the first minimum or maximum; of the first NaN if there is one."""
    extreme = F.array_max(values) if largest else F.array_min(values)
    target = F.when(F.array_contains(values, F.lit(NAN)), F.lit(NAN)).otherwise(extreme)
    return (F.array_position(values, target) - 1).cast("int")


def entropy_bits(weights: Column) -> Column:
    """Shannon entropy of the weights taken as shares w / S: log2 S - sum(w log2 w) / S; a weight of 0 adds 0."""
    terms = F.transform(weights, lambda w: F.when(w > 0, w * F.log2(w)).otherwise(F.when(F.isnan(w), w).otherwise(0.0)))
    whole = total(weights)
    return F.when(whole > 0, F.log2(whole) - total(terms) / whole)


def line_slope(x: Column, y: Column) -> Column:
    """Least-squares slope of y on x over paired arrays of at least two points."""
    n, sx, sy = F.size(x), total(x), total(y)
    sxy = total(F.zip_with(x, y, lambda a, b: a * b)) - F.try_divide(sx * sy, n)
    sxx = total(F.transform(x, lambda a: a * a)) - F.try_divide(sx * sx, n)
    return F.when(n > 1, F.try_divide(sxy, sxx))
