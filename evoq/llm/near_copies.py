"""Near copies of sidecar texts: MinHash bands, sequential Bayesian pruning, exact verification, linked groups."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoq.llm import store, words
from evoq.session import pin


@dataclass(frozen=True)
class NearSpec:
    """Two texts are linked if 100 * shared shingles >= ``percent`` * all their shingles.

    ``bands`` of ``rows`` hashes: at a similarity of 0.85 a pair shares no band once in 1.4e8. ``miss``: a candidate is
    dropped when the posterior chance that it reaches the threshold is below this. A band value with more than
    ``bucket`` texts is compared by blocks of ``block_bytes`` instead of pair by pair.
    """

    percent: int = 85
    shingle: int = 5
    bands: int = 32
    rows: int = 5
    batch: int = 32
    miss: float = 1e-6
    bucket: int = 16
    block_bytes: int = 8 << 20

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(spec: NearSpec) -> list[int]:
    """After 1, 2, ... batches, the fewest equal hashes with which a pair is kept.

    The prior of the similarity is uniform, so after m of n matches the posterior is Beta(m + 1, n - m + 1), and its
    mass at or above t is the chance of at most m successes in n + 1 draws of chance t.
    """
    t, out = spec.percent / 100, []
    for n in range(spec.batch, spec.hashes + 1, spec.batch):
        mass, m = 0.0, -1
        while mass < spec.miss and m < n:
            m += 1
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, n + 1, dtype=np.uint64)
    return (words.mix(at) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (words.mix(at + np.uint64(n)) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Least value of each hash over the shingles, a part of them at a time."""
    short, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(factors), 2**32 - 1, np.uint32)
    for at in range(0, len(short), 2048):
        out = np.minimum(out, (short[at:at + 2048, None] * factors + offsets).min(axis=0))
    return out


def _sets(column, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text with a word."""
    for block in words.blocks_of_words(column):
        for i in range(block.last - block.first):
            own = block.hashes[block.rows[i]:block.rows[i + 1]]
            if len(own):
                yield block.first + i, np.unique(words.shingles(own, size))


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sketches(sidecars: DataFrame, key: str, content: str, spec: NearSpec) -> DataFrame:
    """``key, n_shingles, set_id, place, signature``: the digest of the shingle set, 64 bits of it as a number, and its MinHash
    signature; NULL without words."""
    kind = sidecars.schema[key].dataType.simpleString()
    hashes, size = spec.hashes, spec.shingle

    def run(batches):
        factors, offsets = _multipliers(hashes)
        for batch in batches:
            n, ids, places, signs = [0] * batch.num_rows, *([None] * batch.num_rows for _ in range(3))
            for row, found in _sets(batch.column(1), size):
                n[row], ids[row] = len(found), _digest(found)
                places[row], signs[row] = _short(ids[row]), signature(found, factors, offsets).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(places, pa.int64()),
                 pa.array(signs, pa.binary())], ["key", "n_shingles", "set_id", "place", "signature"])

    schema = f"key {kind}, n_shingles bigint, set_id binary, place bigint, signature binary"
    return sidecars.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content")).mapInArrow(words.giving_back(run), schema)


def chosen_sets(sidecars: DataFrame, content: str, wanted: np.ndarray, spec: NearSpec) -> DataFrame:
    """``set_id, shingles`` of the texts whose set may be among the wanted ones; a task gives most sets only once."""
    size = spec.shingle

    def run(batches):
        given: set[bytes] = set()
        for batch in batches:
            ids, sets, held = [], [], 0
            for _, found in _sets(batch.column(0), size):
                digest = _digest(found)
                if digest in given or not words.may_hold(wanted, np.array([_short(digest)], np.int64))[0]:
                    continue
                if len(given) > 100_000:
                    given.clear()
                given.add(digest)
                ids.append(digest)
                sets.append(found.view(np.int64))
                held += len(found)
                if held > 1 << 20:
                    yield _set_rows(ids, sets)
                    ids, sets, held = [], [], 0
            yield _set_rows(ids, sets)

    return sidecars.select(F.col(content).cast("string").alias("content")).mapInArrow(words.giving_back(run), "set_id binary, shingles array<bigint>")


def _set_rows(ids: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                                      ["set_id", "shingles"])


def _prune(pairs: DataFrame, spec: NearSpec) -> DataFrame:
    """Compare signatures batch by batch and drop pairs whose posterior falls below the miss probability."""
    least, batch_size, hashes = least_matches(spec), spec.batch, spec.hashes

    def run(batches):
        for batch in batches:
            alive = np.arange(batch.num_rows)
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, hashes) for c in (2, 3))
                found = np.zeros(batch.num_rows, np.int64)
                for i, fewest in enumerate(least):
                    part = slice(i * batch_size, (i + 1) * batch_size)
                    found[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
                    alive = alive[found[alive] >= fewest]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(words.giving_back(run), "a bigint, b bigint")


def cluster_links(cids: np.ndarray, blocks: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], spec: NearSpec) -> list[tuple[int, int]]:
    """Verified links that join the members of one or two blocks as far as they can be joined.

    Pairs that share a band and survive the batches are verified on their full sets, a row at a time; pairs that earlier
    links have joined already are not looked at again.
    """
    n, out = len(cids), []
    least = least_matches(spec)
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    flags = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    mixed = signs.reshape(n, spec.bands, spec.rows).astype(np.uint64)
    keys = np.zeros((n, spec.bands), np.uint64)
    for r in range(spec.rows):
        keys = words.mix(keys + mixed[:, :, r])
    two = len(set(blocks.tolist())) > 1
    first = blocks.min() if n else 0
    for i in range(n):
        others = np.arange(i + 1, n)
        if two:
            if blocks[i] != first:
                continue
            others = np.flatnonzero(blocks != first)
        others = others[root[others] != root[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * small >= spec.percent * large]
        others = others[(keys[others] == keys[i]).any(axis=1)]
        found = np.zeros(len(others), np.int64)
        for k, fewest in enumerate(least):
            part = slice(k * spec.batch, (k + 1) * spec.batch)
            found += (signs[others, part] == signs[i, part]).sum(axis=1)
            keep = found >= fewest
            others, found = others[keep], found[keep]
        if not len(others):
            continue
        flags[codes[ends[i]:ends[i + 1]]] = 1
        lengths = sizes[others]
        bounds = np.cumsum(lengths) - lengths
        at = np.repeat(ends[others] - bounds, lengths) + np.arange(int(lengths.sum()))
        shared = np.add.reduceat(flags[codes[at]], bounds)
        flags[codes[ends[i]:ends[i + 1]]] = 0
        for j in others[100 * shared >= spec.percent * (lengths + sizes[i] - shared)]:
            if root[j] != root[i]:
                out.append((int(cids[i]), int(cids[j])))
                root[root == root[j]] = root[i]
    return out


def _by_blocks(members: DataFrame, spec: NearSpec) -> DataFrame:
    """Links within large clusters (``cluster, a, n, signature, shingles``): every pair of blocks is one task group."""
    load = F.lit(8) * F.col("n") + F.lit(4 * spec.hashes)
    sizes = pin(members.groupBy("cluster").agg(F.ceil(F.sum(load) / spec.block_bytes).cast("int").alias("blocks")))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1))) \
        .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "a", "block", "signature", "shingles")

    def run(group: pa.Table) -> pa.Table:
        signs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint32).reshape(group.num_rows, -1)
        lists = group["shingles"].combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [flat[ends[k]:ends[k + 1]] for k in range(group.num_rows)]
        links = cluster_links(group["a"].to_numpy(), group["block"].to_numpy(), signs, sets, spec)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return spread.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_copies(sidecars: DataFrame, key: str = "key", content: str = "content", spec: NearSpec = NearSpec()) -> DataFrame:
    """One row per sidecar: ``key, n_shingles, component, kept``.

    ``sidecars`` holds the texts of the stored JSON sidecars (``dataset, key, content``); other columns are ignored. A text's set
    is its distinct shingles of five words (A-Z lower-cased); with fewer words the whole sequence is one shingle. Texts
    whose sets overlap by 85 % are linked; ``component`` is the least key that links reach and ``kept`` marks its row.

    * A null, empty or blank text has no shingle, is linked with nothing and is its own component.
    * Texts of one set are one class: copies are never compared. Rows that repeat a key are rows of their own and share
      the component of their text; two rows of the least key are both kept.
    * A null key is never the least key; a component of null keys only has a null component and keeps its rows.
    * An empty table gives an empty table.
    """
    rows = pin(sketches(sidecars, key, content, spec))
    classes = pin(rows.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("key").alias("least_key"), F.first("n_shingles").alias("n"), F.first("place").alias("place"),
        F.first("signature").alias("signature"))
        .withColumn("cid", F.monotonically_increasing_id()))
    width = 4 * spec.rows
    banded = classes.select("cid", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(spec.bands - 1)),
        lambda i: F.expr("signature").substr(i * width + 1, F.lit(width)))).alias("band", "part")) \
        .select("cid", F.xxhash64("band", "part").alias("value"))
    common = banded.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("first")).where("size > 1")
    members = pin(banded.join(common, "value"))

    few = members.where(F.col("size") <= spec.bucket).groupBy("value").agg(F.array_sort(F.collect_list("cid")).alias("cids"))
    pairs = few.select(F.explode(F.flatten(F.transform("cids", lambda x, i: F.transform(
        F.slice("cids", i + 2, F.size("cids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")) \
        .select("p.a", "p.b").distinct()
    side = classes.select("cid", "n", "signature")
    pairs = pairs.join(side.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("sig_a")), "a") \
        .join(side.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("sig_b")), "b") \
        .where(100 * F.least("n_a", "n_b") >= spec.percent * F.greatest("n_a", "n_b"))
    pairs = pin(_prune(pairs, spec))

    many = members.where(F.col("size") > spec.bucket)
    clusters = pin(store.components(many.select(F.col("first").alias("u"), F.col("cid").alias("v")))
                   .select(F.col("node").alias("a"), F.col("component").alias("cluster")))

    needed = pin(pairs.select("a").union(pairs.select("b")).union(clusters.select("a")).distinct()
                 .join(classes.select(F.col("cid").alias("a"), "set_id", "place", "n", "signature"), "a"))
    wanted = store.key_filter(needed, "place")
    sets = pin(chosen_sets(sidecars, content, wanted, spec).groupBy("set_id").agg(F.first("shingles").alias("shingles"))
               .join(needed.select("a", "set_id", "n"), "set_id").select("a", "n", "shingles"))

    left = sets.select("a", F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    checked = pairs.join(left, "a").join(right, "b") \
        .withColumn("shared", F.size(F.array_intersect("set_a", "set_b"))) \
        .where(100 * F.col("shared") >= spec.percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")
    hot = _by_blocks(clusters.join(sets, "a").join(needed.select("a", "signature"), "a"), spec)
    links = pin(checked.union(hot)).select(F.col("a").alias("u"), F.col("b").alias("v"))

    joined = pin(store.components(links))
    named = classes.join(joined.withColumnRenamed("node", "cid"), "cid")
    least = named.groupBy("component").agg(F.min("least_key").alias("linked_key"))
    labels = classes.select("set_id", "cid", "least_key").join(joined.withColumnRenamed("node", "cid"), "cid", "left") \
        .join(least, "component", "left").select("set_id", F.coalesce("linked_key", "least_key").alias("component"))
    return rows.select("key", "n_shingles", "set_id").join(labels, "set_id", "left").select(
        "key", "n_shingles", F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("component")).alias("component")) \
        .withColumn("kept", F.col("key").eqNullSafe(F.col("component")))
