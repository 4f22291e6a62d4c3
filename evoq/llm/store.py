"""Tables between the steps of an operator, bounded key filters and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoq.session import pin

FILTER_BITS = 27
_CHUNK = 32768


def key_filter(df: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``2**bits`` bits (16 MB, whatever the rows) with the bit of every 64-bit ``key`` set.

    It only saves work: a row whose bit is unset has none of the keys, one whose bit is set may have one. It is built in
    Spark; at most ``2**bits / 32768`` rows of 4 KB reach the driver.
    """
    place = F.shiftrightunsigned(F.col(key), 64 - bits)
    rows = df.select(place.alias("_p")).groupBy(F.expr(f"_p div {_CHUNK}").alias("_chunk")).agg(
        F.expr(f"bitmap_construct_agg(_p % {_CHUNK})").alias("_bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.toLocalIterator():
        out[row["_chunk"] * 4096:(row["_chunk"] + 1) * 4096] = np.frombuffer(row["_bits"], np.uint8)
    return out


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return row[0], row[1] or 0


def _to_least(edges: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours are tied to the least of them (or the node): those above it, or those below and itself."""
    if both:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        tied = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of all nodes with an edge; ``edges`` has longs ``u, v``.

    Large-star and small-star rounds; each is written to the shared folder. A hub's edges are joined to one row per
    node, so the adaptive planner can split them, and minima have partial sums.
    """
    now = pin(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _fingerprint(now)
    while mark[0]:
        now = pin(_to_least(_to_least(now, True), False))
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
