"""Ranks and order statistics over whole tables without a single-partition sort.

Rows are put into ordered buckets, bucket totals (a bounded table) give each bucket its offset, and only the order
inside a bucket is sorted, each bucket in its own task. Hot values collapse to one counted row beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoq.session import pin

SKETCH = 10_000  # accuracy of the sketch around exact quantiles
INSIDE, BINS = 100_000, 1024  # rows around a wanted place that are ordered by one task; parts a larger range is cut into


def first_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps only n per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def shuffle_digest(seed: int, *key: Column) -> Column:
    """A reproducible random order for rows named by ``key``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


_PRIME = 2_147_483_647  # below 2^31, so a product of two remainders fits a long
ROUNDS, WALK = 4, 64


def keyed_permutation(place: Column, n: Column, seed: int, *key: Column) -> Column:
    """The number 1..n at ``place`` in a permutation of 1..n named by seed and ``key``: a bijection, in column arithmetic alone.

    A Feistel network over pairs of digits below ceil(sqrt(n)); what falls beyond n is sent through again. Of the n + 2 sqrt(n) pairs so
    few are beyond that 64 walks never end there for n above 64, and up to it no walk is longer; if one were, an error is raised.
    """
    side = F.ceil(F.sqrt(n)).cast("bigint")
    keys = F.array(*[F.conv(F.substring(shuffle_digest(seed, *key, F.lit(i)), 1, 7), 16, 10).cast("bigint") for i in range(ROUNDS)])

    def stir(half: Column, k: Column) -> Column:
        square = lambda v: (v % _PRIME) * (v % _PRIME) % _PRIME
        return square(square(half + k) * 48_271 + k)

    def once(x: Column) -> Column:
        halves = F.struct(F.floor(x / side).alias("l"), (x % side).alias("r"))
        step = lambda h, k: F.struct(h["r"].alias("l"), ((h["l"] + stir(h["r"], k)) % side).alias("r"))
        return F.aggregate(keys, halves, step, lambda h: h["l"] * side + h["r"])

    start = (place - 1).cast("bigint")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(start.alias("x"), F.lit(False).alias("done")), lambda h, _: F.when(h["done"], h)
                         .otherwise(F.transform(F.array(once(h["x"])), lambda x: F.struct(x.alias("x"), (x < n).alias("done")))[0]))
    return F.when(walked["done"], walked["x"] + 1).otherwise(F.raise_error(F.lit("no place in the permutation")).cast("bigint"))


def digest_position(df: DataFrame, digest: str, by: list[str] | None = None, position: str = "position",
                    size: str = "group_size") -> DataFrame:
    """1-based place of each row in the order of its digest (within ``by``), and the number of rows there.

    The bucket is the head of the digest, so buckets are even. There are up to 16^5 of them, counted in two levels: a task orders
    the 16^2 buckets of one head of three digits, and one the 16^3 heads.
    """
    by = by or []
    bucketed = df.withColumn("_b", F.substring(digest, 1, 5))
    totals = bucketed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.substring("_b", 1, 3))
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = totals.groupBy(*by, "_h").agg(F.sum("_n").alias("_hn")).select(
        *by, "_h", earlier("_hn", Window.partitionBy(*by).orderBy("_h")).alias("_above"), F.sum("_hn").over(Window.partitionBy(*by)).alias(size))
    offsets = totals.withColumn("_within", earlier("_n", Window.partitionBy(*by, "_h").orderBy("_b"))).join(heads, [*by, "_h"]) \
        .select(*by, "_b", size, (F.col("_above") + F.col("_within")).alias("_before"))
    inside = Window.partitionBy(*by, "_b").orderBy(digest)
    return bucketed.join(offsets, [*by, "_b"]) \
        .withColumn(position, F.col("_before") + F.row_number().over(inside)).drop("_b", "_before")


def in_ranges(rows: DataFrame, order: list[str], per_range: int) -> DataFrame:
    """Pinned rows with ``_b``, their range in the order of the columns: Spark's range partitioning by sampled cuts, as many ranges as
    rows need at ``per_range`` each, so that ranges follow the rows at any size."""
    held = pin(rows)
    ranges = -(-held.count() // per_range)
    return pin(held.repartitionByRange(max(1, ranges), *order).withColumn("_b", F.spark_partition_id()))


def beside(df: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """The columns of the one row per group of ``one`` beside the rows of ``df``; without groups as a scalar, not by a join."""
    if by:
        return df.join(one, by)
    return df.withColumn("_one", one.select(F.struct(*one.columns)).scalar()).select(*df.columns, "_one.*")


def _bucket_offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each bucket and rows of the group; one row per bucket is ordered here."""
    w = Window.partitionBy(*by)
    before = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0))) \
        .withColumn("_size", F.sum("_bn").over(w))


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, rank: str = "rank",
                 descending: bool = True, per_range: int = 1_000_000) -> DataFrame:
    """``by, value, rank``: the rank of each distinct value, equal values sharing their mean place.

    Distinct values with their counts lie in ranges of about ``per_range``; a task orders one range, and only counts per range are
    ordered per group.
    """
    by = by or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = in_ranges(counted, [*by, value], per_range)
    offsets = _bucket_offsets(ranged.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn")), by)
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(offsets, [*by, "_b"]).withColumn(
        "_below", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ascending = F.col("_below") + (F.col("_n") + 1) / 2
    return placed.select(*by, value, (F.col("_size") + 1 - ascending if descending else ascending).alias(rank))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``by, share, quantile``: exact, interpolated linearly between neighbours.

    Spark's own exact ``percentile`` keeps every distinct value of a group in one buffer. Here a bounded sketch gives
    two values around each wanted place, one pass counts the rows below and inside, and only the rows inside (some
    thousandth of the table) are shuffled and ordered, equal values as one. Where the counts show that a sketch missed
    the place, all rows of that group count as inside, so the result is exact in any case. While more than ``INSIDE`` rows
    are inside, the range is cut into ``BINS`` counted parts, of which those that hold the place stay: so no task orders more.
    """
    v, margin = F.col(value), 4 / SKETCH
    rows = df.select(*by, value).where(v.isNotNull())
    probes = [p for s in shares for p in (max(s - margin, 0.0), min(s + margin, 1.0))]
    at = lambda p, i: F.get("_q", F.lit(i)) if 0 < p < 1 else F.lit(None).cast("double")  # no bound at either end
    sketch = rows.groupBy(*by).agg(F.percentile_approx(value, probes, SKETCH).alias("_q"))
    bounds = pin(sketch.select(*by, *[at(p, i).alias(f"_{'lh'[i % 2]}{i // 2}") for i, p in enumerate(probes)]))
    counts = beside(rows, bounds, by).groupBy(*bounds.columns).agg(
        F.count(F.lit(1)).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        *[F.count_if(v < F.col(f"_l{i}")).alias(f"_b{i}") for i in range(len(shares))],
        *[F.count_if(v <= F.col(f"_h{i}")).alias(f"_e{i}") for i in range(len(shares))])
    places = []
    for i, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("_n") - 1)
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        holds = (low.isNull() | (F.col(f"_b{i}") <= F.floor(place))) & (high.isNull() | (F.ceil(place) < F.col(f"_e{i}")))
        places.append(F.struct(
            F.lit(float(s)).alias("share"), place.alias("_at"), F.coalesce(F.when(holds, low), "_min").alias("_l"),
            F.coalesce(F.when(holds, high), "_max").alias("_h"),
            F.when(holds & low.isNotNull(), F.col(f"_b{i}")).otherwise(0).cast("bigint").alias("_before"),
            (F.when(holds & high.isNotNull(), F.col(f"_e{i}")).otherwise(F.col("_n"))
             - F.when(holds & low.isNotNull(), F.col(f"_b{i}")).otherwise(0)).alias("_in")))
    wanted = pin(counts.select(*by, F.array(*places).alias("_wanted")))
    wanted = narrowed(rows, wanted, by, value)
    inside = beside(rows, wanted, by).select(*by, value, F.inline("_wanted")).where((v >= F.col("_l")) & (v <= F.col("_h")))
    counted = inside.groupBy(*by, "share", "_at", "_before", value).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by, "share").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    here = lambda place: F.max(F.when((F.col("_from") <= place) & (place < F.col("_from") + F.col("_n")), v))
    ends = placed.groupBy(*by, "share", "_at").agg(here(F.floor("_at")).alias("_v0"), here(F.ceil("_at")).alias("_v1"))
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_at") - F.floor("_at"))
    return ends.select(*by, "share", F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(between).alias("quantile"))


def narrowed(rows: DataFrame, wanted: DataFrame, by: list[str], value: str) -> DataFrame:
    """``wanted`` (per group an array of places with their range ``_l`` .. ``_h`` and the rows ``_before`` and ``_in`` it) with the ranges of more
    than ``INSIDE`` rows narrowed by counted parts; a range of one value, or of infinite width, stays."""
    v, low, high = F.col(value), F.col("_l"), F.col("_h")
    for _ in range(8):  # each round divides the width by BINS: no two doubles stay together
        wide = pin(wanted.select(*by, F.inline("_wanted")).where((F.col("_in") > INSIDE) & (high - low > 0) & (high - low < float("inf"))))
        if wide.isEmpty():
            break
        place = [*by, "share"]
        part = F.least(F.floor((v - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("_part")
        # A range per wanted place: few and short, they go to the rows.
        ranges = wide.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in wide.columns if c not in by])).alias("_wide"))
        cells = beside(rows, pin(ranges), by).select(*by, value, F.inline("_wide")).where((v >= low) & (v <= high)) \
            .groupBy(*place, "_at", "_before", part).agg(F.count(F.lit(1)).alias("_m"), F.min(v).alias("_low"), F.max(v).alias("_high"))
        below = Window.partitionBy(*place).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_m").over(below), F.lit(0)))
        holds = (F.col("_from") <= F.ceil("_at")) & (F.floor("_at") < F.col("_from") + F.col("_m"))
        fresh = cells.where(holds).groupBy(*place).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_from").alias("_from"), F.sum("_m").alias("_m"))
        every = wanted.select(*by, F.inline("_wanted"))
        same = F.lit(True)
        for c in place:
            same = same & every[c].eqNullSafe(fresh[c])
        merged = every.join(fresh, same, "left").select(
            *[every[c] for c in place], "_at", F.coalesce("_low", low).alias("_l"), F.coalesce("_high", high).alias("_h"),
            F.coalesce("_from", "_before").alias("_before"), F.coalesce("_m", "_in").alias("_in"))
        wanted = pin(merged.groupBy(*by).agg(F.collect_list(F.struct("share", "_at", "_l", "_h", "_before", "_in")).alias("_wanted")))
    return wanted


def wide_quantiles(df: DataFrame, by: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """One row per group with a column per named share."""
    long = exact_quantiles(df, by, value, list(named.values()))
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n)
                                   for n, s in named.items()])
