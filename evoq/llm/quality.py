"""Quality of sidecar texts by votes of their nearest marked neighbours among latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoq.llm import words
from evoq.session import pin


@dataclass(frozen=True)
class QualitySpec:
    """``sample``: marked texts per mark that are learnt from, a bound on training only; all texts are scored.

    ``terms`` hashed terms (a power of two) are reduced to ``dimensions``; the ``neighbours`` nearest of the sample (and those as near as the
    last) vote with the power ``sharpness`` of their cosine, against ``prior`` votes of the marks' shares.
    """

    sample: int = 1500
    terms: int = 4096
    dimensions: int = 48
    neighbours: int = 25
    sharpness: float = 8.0
    prior: float = 0.05
    run: int = 4
    seed: int = 11


_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[128:] = 97
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Steps of the share of repeated runs, the last of the terms; each step reached counts as often as the text has words.
_SHARES = 8


def _spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts: the first text's row, the bytes, the bounds of the texts; a text beyond a block is cut at white space."""
    for first, last in words.slices(offsets):
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= 4 * words.BLOCK:
            yield first, data[low:high], offsets[first:last + 1] - low
            continue
        at = low
        while at < high:
            end = min(at + words.BLOCK, high)
            while end < high and data[end] > 32:
                end += 1
            yield first, data[at:end], np.array([0, end - at])
            at = end


def term_counts(column, spec: QualitySpec) -> np.ndarray:
    """A row of term counts per text of a block of rows: its words, the shapes of their ends, and how much of it repeats.

    The shape is the kind of a word's first and last three characters, letters and digits each being of one kind. A run
    of four words repeats if it came before in the same block of 256 KB of the text.
    """
    data, offsets = words.text_bytes(column)
    n, width = len(offsets) - 1, spec.terms
    counts, total, repeated = np.zeros((n, width), np.float32), np.zeros(n), np.zeros(n)
    shift = np.uint64(64 - (width.bit_length() - 1))
    for first, raw, bounds in _spans(data, offsets):
        found = words.Words(first, first + len(bounds) - 1, words.lowered(raw), bounds)
        rows, size = np.repeat(np.arange(len(bounds) - 1), np.diff(found.rows)), len(bounds) - 1
        if not len(rows):
            continue
        starts, ends = found.starts, found.ends
        shape = _CLASS[raw[starts]]
        for back in (1, 2, 3):
            shape = shape * np.uint64(257) + np.where(ends - back > starts, _CLASS[raw[np.maximum(ends - back, starts)]], np.uint64(0))
        terms = np.concatenate([found.hashes * _STEP >> shift, words.mix(shape + _STEP) >> shift]).astype(np.int64)
        terms = np.minimum(terms, width - _SHARES - 1)
        counts[first:first + size] += np.bincount(np.concatenate([rows, rows]) * width + terms, minlength=size * width).reshape(size, width)
        total[first:first + size] += np.bincount(rows, minlength=size)
        k = spec.run
        if len(rows) >= k:
            runs = found.hashes[:len(rows) - k + 1].copy()
            for j in range(1, k):
                runs = runs * _STEP + found.hashes[j:len(rows) - k + 1 + j]
            inside = rows[k - 1:] == rows[:len(rows) - k + 1]
            of, keys = rows[:len(runs)][inside], words.mix(runs + rows[:len(runs)].astype(np.uint64))[inside]
            _, at = np.unique(keys, return_index=True)
            again = np.ones(len(keys), bool)
            again[at] = False
            repeated[first:first + size] += np.bincount(of[again], minlength=size)
    share = np.where(total > 0, repeated / np.maximum(total, 1), 0)
    bucket = np.minimum((share * _SHARES).astype(np.int64), _SHARES - 1)
    counts[:, width - _SHARES:] = total[:, None] * (np.arange(_SHARES) <= bucket[:, None])
    return counts


@dataclass
class QualityModel:
    """Weights of the terms, projection, unit vectors of the sample, and what each votes; its size is bounded by the spec."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    marks: np.ndarray
    worth: np.ndarray
    share: float

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        found = _weighted(counts, self.weights) @ self.projection
        length = np.linalg.norm(found, axis=1, keepdims=True)
        return np.divide(found, length, out=np.zeros_like(found), where=length > 1e-9)

    def scores(self, counts: np.ndarray, spec: QualitySpec) -> np.ndarray:
        """Weighted share of mark 1 among the nearest; without any neighbour the marks' own share."""
        if not len(self.marks):
            return np.full(len(counts), self.share)
        near = np.round(self.vectors_of(counts) @ self.vectors.T, 5)
        if near.shape[1] > spec.neighbours:
            last = np.partition(near, -spec.neighbours, axis=1)[:, -spec.neighbours]
            near = np.where(near >= last[:, None], near, 0)
        votes = np.maximum(near, 0) ** spec.sharpness * self.worth
        return (votes @ self.marks + spec.prior * self.share) / (votes.sum(axis=1) + spec.prior)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    found = np.log1p(counts) * weights
    length = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, length, out=np.zeros_like(found), where=length > 0)


def train(counts: np.ndarray, marks: np.ndarray, totals: dict[int, int], spec: QualitySpec) -> QualityModel:
    """Latent-semantic analysis of the sample: inverse document frequencies, then the leading singular vectors by subspace
    iteration from a seeded start. ``totals``: how many texts have each mark; a sampled one votes for as many as it stands for."""
    total = sum(totals.values())
    if not len(marks):
        return QualityModel(np.zeros(spec.terms, np.float32), np.zeros((spec.terms, 1), np.float32), np.zeros((0, 1), np.float32),
                            np.zeros(0), np.zeros(0), 0.5)
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    x = _weighted(counts, weights)
    rank = min(spec.dimensions, len(x))
    basis = np.random.default_rng(spec.seed).normal(size=(spec.terms, min(rank + 8, spec.terms))).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ right[:rank].T).astype(np.float32)
    worth = np.array([totals[m] / (marks == m).sum() for m in (0, 1) if (marks == m).any()])
    each = dict(zip([m for m in (0, 1) if (marks == m).any()], worth / worth.max()))
    model = QualityModel(weights, projection, np.zeros((0, rank), np.float32), marks.astype(float), np.array([each[m] for m in marks]),
                         totals.get(1, 0) / total)
    model.vectors = model.vectors_of(counts)
    return model


def training_sample(sidecars: DataFrame, marks: DataFrame, key: str, content: str, quality: str,
                    spec: QualitySpec) -> tuple[DataFrame, dict[int, int]]:
    """``quality, counts`` of at most ``spec.sample`` keys per mark, in the order of a hash, and the number of keys of each mark.

    Only keys whose hash lies under a threshold, set by the counts, are put in order. Where a key has several texts, the one
    of the least digest is learnt from.
    """
    keyed = marks.where(F.col(quality).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(quality).cast("int").alias("quality")).distinct()
    keyed = pin(keyed.join(sidecars.where(F.col(content).isNotNull()).select(F.col(key).alias("key")), "key", "left_semi"))
    totals = {row[0]: row[1] for row in keyed.groupBy("quality").count().collect()}
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for mark, n in totals.items():
        share = F.when(F.col("quality") == mark, F.lit(min(1.0, (1.5 * spec.sample + 50) / n))).otherwise(share)
    order = Window.partitionBy("quality").orderBy("place", "key")
    ids = keyed.withColumn("place", place).where(F.col("place") <= share).withColumn("nth", F.row_number().over(order)) \
        .where(F.col("nth") <= spec.sample).select("key", "quality")
    texts = sidecars.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content")).where("content is not null")
    texts = texts.join(F.broadcast(pin(ids)), "key").select(texts["key"], "quality", F.xxhash64("content").alias("digest"), "content")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = term_counts(part.column(3), spec)
                rows = [np.flatnonzero(c) for c in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())),
                     pa.array([c[r] for c, r in zip(found, rows)], pa.list_(pa.float32()))], ["key", "quality", "digest", "terms", "times"])

    kind = texts.schema["key"].dataType.simpleString()
    counted = texts.mapInArrow(run, f"key {kind}, quality int, digest bigint, terms array<int>, times array<float>")
    return counted.groupBy("key", "quality").agg(F.min(F.struct("digest", "terms", "times")).alias("of")) \
        .select("key", "quality", "of.terms", "of.times"), totals


def fit_quality_model(sidecars: DataFrame, marks: DataFrame, key: str = "key", content: str = "content", quality: str = "quality",
                      spec: QualitySpec = QualitySpec()) -> QualityModel:
    rows, totals = training_sample(sidecars, marks, key, content, quality, spec)
    found = rows.orderBy("quality", "key").toArrow()
    counts = np.zeros((found.num_rows, spec.terms), np.float32)
    for i, (terms, times) in enumerate(zip(found["terms"], found["times"])):
        counts[i, terms.values.to_numpy(zero_copy_only=False)] = times.values.to_numpy(zero_copy_only=False)
    return train(counts, found["quality"].to_numpy(), totals, spec)


def score_quality(sidecars: DataFrame, marks: DataFrame, key: str = "key", content: str = "content", quality: str = "quality",
                  held_out: Column | None = None, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """One row per sidecar text: ``key, held_out, score, predicted``. ``score`` (0 to 1) is the similarity-weighted share of mark 1
    among the nearest marked texts, ``predicted`` 1 from 0.5 on.

    Studies mark no sidecars themselves, so ``marks`` has ``key`` and a ``quality`` of 0 or 1 per checked sidecar; other
    marks and null keys are not learnt from, nor are keys that are ``held_out`` (a condition on a column ``key``, whatever its name was).
    A key marked both ways counts both ways. The text alone is scored: a null or empty one has no vector and gets the share
    of mark 1 among all marks learnt from (0.5 without any). Repeated rows give repeated results, an empty table an empty one.
    The model is broadcast; its size depends on the spec alone (2 x 1,500 vectors of 48 numbers and 4,096 x 48 of projection).
    """
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = sidecars.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content"))
    known = marks.select(F.col(key).alias("key"), F.col(quality).alias("quality")).where(~held_out)
    model = sidecars.sparkSession.sparkContext.broadcast(vars(fit_quality_model(rows, known, "key", "content", "quality", spec)))

    def run(batches):
        fitted = QualityModel(**model.value)
        for batch in batches:
            scores = [fitted.scores(term_counts(batch.column(2).slice(at, 256), spec), spec) for at in range(0, batch.num_rows, 256)]
            scores = np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))],
                ["key", "held_out", "score", "predicted"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", held_out.alias("held_out"), "content") \
        .mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int")
