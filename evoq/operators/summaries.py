"""Grouped summaries: counts, describe, crosstab, histograms, box plots, correlation, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.operators.ranking import wide_quantiles
from evoq.session import pin


def group_count(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Rows per group; rows with a missing key belong to no group."""
    return df.na.drop(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def describe(df: DataFrame, by: list[str], value: str, full: bool = False) -> DataFrame:
    """count, mean, std, min, max per group, with ``full`` also the quartiles. A group of NULLs stays, count 0."""
    v = F.col(value)
    basic = df.na.drop(subset=by).groupBy(*by).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    if not full:
        return basic
    quartiles = wide_quantiles(df, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    if by:
        return basic.join(quartiles, by, "left")
    return basic.withColumn("_q", quartiles.select(F.struct("q25", "q50", "q75")).scalar()).select("*", "_q.*").drop("_q")


def trials_per_subject(df: DataFrame) -> DataFrame:
    return group_count(df, ["dataset", "subject"], "n_trials")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each ``column`` value per ``row`` value, 0 where none.

    The values are named, so one pass is enough; all others are counted in the column ``other``.
    """
    kept = df.na.drop(subset=[row, column])
    named = F.when(F.col(column).isin(values), F.col(column)).otherwise("other")
    return kept.withColumn("_value", named).groupBy(row).pivot("_value", [*values, "other"]) \
        .agg(F.count(F.lit(1))).na.fill(0)


def equal_width_histogram(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """``by, bin, low, high, n, density``: equal bins from the least to the largest value of each group.

    The last bin is closed at the top, a group of one value gets the range value -0.5 to +0.5, and empty bins stay.
    Only the ranges (one row per group, pinned) are joined to the rows.
    """
    kept = df.select(by, value).na.drop()
    ranges = kept.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("total"))
    one = F.col("lo") == F.col("hi")
    ranges = pin(ranges.select(by, "total", F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                           F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")))
    edge = lambda i: F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / bins))
    v = F.col(value)
    guess = F.least(F.floor((v - F.col("lo")) * (bins / (F.col("hi") - F.col("lo")))).cast("int"), F.lit(bins - 1))
    placed = kept.join(ranges, by).withColumn("_g", guess)
    g = F.col("_g")
    # Division may land one bin off; the edges themselves decide.
    placed = placed.withColumn("bin", F.when(v < edge(g), g - 1)
                               .when((v >= edge(g + 1)) & (g < bins - 1), g + 1).otherwise(g))
    counts = placed.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    b = F.col("bin")
    n = F.coalesce("n", F.lit(0))
    return spine.join(counts, [by, "bin"], "left").select(
        by, "bin", edge(b).alias("low"), edge(b + 1).alias("high"), n.alias("n"),
        (n / (F.col("total") * (edge(b + 1) - edge(b)))).alias("density"))


def unit_histogram(df: DataFrame, by: str, value: str, low: int = 0, high: int = 11) -> DataFrame:
    """Whole-number bins from ``low`` to ``high``; other values fall out of counts and density alike."""
    v = F.col(value)
    kept = df.where(v.between(low, high))
    counts = kept.groupBy(by, F.least(F.floor(v).cast("int"), F.lit(high - 1)).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    spine = totals.withColumn("bin", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    n = F.coalesce("n", F.lit(0))
    return spine.join(counts, [by, "bin"], "left").select(by, "bin", n.alias("n"), (n / F.col("total")).alias("density"))


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whiskers (outermost values within 1.5 quartile ranges) and the count of values beyond."""
    quartiles = pin(wide_quantiles(df, [by], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return df.select(by, value).na.drop().join(quartiles, by).groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def pearson(df: DataFrame, by: str, x: str, y: str, more_than: int = 2) -> DataFrame:
    """Correlation over the complete pairs of each group of more than two; NULL where a side does not vary."""
    pairs = valid_pairs(df, x, y)
    return pairs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r")).where(F.col("n") > more_than)


def valid_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def share_pct(condition: Column) -> Column:
    return F.lit(100.0) * F.count_if(condition) / F.greatest(F.count(F.lit(1)), F.lit(1))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return group_count(df, [value])


def fraction_at_minimum(df: DataFrame, value: str) -> DataFrame:
    """Share of the rows that hold the least value; rows without one count in the denominator only."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.min_by("n", F.col(value)) / F.sum("n")).alias("fraction_at_min"))


def group_size_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean group size, groups of one row, all groups."""
    return group_count(df, by).agg(F.avg("n").alias("mean_size"), F.count_if(F.col("n") == 1).alias("n_single"),
                                   F.count(F.lit(1)).alias("n_groups"))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells and share per column, one row per column, from one pass over the rows."""
    name = lambda c: F.col(f"`{c}`")
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(name(c).isNull()).alias(f"m{i}")
                                                      for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("n_missing"))
                      for i, c in enumerate(columns)])
    return one.select("n_rows", F.inline(cells)).select(
        "feature", "n_missing", F.try_divide(F.col("n_missing"), F.col("n_rows")).alias("missing_share"))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, median``: exact, all columns in one pass through the bucketed order statistics."""
    long = to_long(df, [], columns)
    return wide_quantiles(long, ["feature"], "value", {"median": 0.5})


def to_long(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
                      for c in columns])
    return df.select(*keep, F.inline(cells))


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULLs with the column's median; the medians are one row, a value per column."""
    name = lambda c: F.col(f"`{c}`")
    row = medians(df, columns).agg(F.struct(*[
        F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"m{i}") for i, c in enumerate(columns)]))
    filled = {c: F.coalesce(name(c).cast("double"), F.col(f"_m.m{i}")) for i, c in enumerate(columns)}
    return df.withColumn("_m", row.scalar()).select(
        *[filled[c].alias(c) if c in filled else name(c) for c in df.columns])


def regression_scores(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """R2 and mean absolute error."""
    y, p = F.col(actual), F.col(predicted)
    return df.groupBy(*(by or [])).agg(
        (F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"))


def montage_summary(epochs: DataFrame) -> DataFrame:
    """Channels and sampling rate per subject; channels are made distinct before they are counted."""
    rows = epochs.groupBy("dataset", "subject", "channel").agg(F.max("sfreq").alias("sfreq"))
    return rows.groupBy("dataset", "subject").agg(F.count(F.lit(1)).alias("n_channels"), F.max("sfreq").alias("sfreq"))
