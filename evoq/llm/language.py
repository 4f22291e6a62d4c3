"""Language of sidecar texts: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoq.llm import words
from evoq.session import pin


@dataclass(frozen=True)
class LanguageSpec:
    """``sample``: texts per language that are learnt from; with many languages less, so that they are at most ``rows`` in all (but one each),
    and ``bytes`` of counted subwords: bounds on training only, whatever the number of languages.

    Every fifth of the sample calibrates: one temperature, and for rejection the score under which a share
    ``reject`` of right calibration texts lies, lowered to ``margin`` of it.
    """

    sample: int = 1000
    rows: int = 4000
    bytes: int = 96 << 20
    buckets: int = 1 << 15
    dimensions: int = 16
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    epochs: int = 12
    rate: float = 0.5
    batch: int = 32
    seed: int = 7
    reject: float = 0.002
    margin: float = 0.5


def subwords(data: np.ndarray, spec: LanguageSpec) -> np.ndarray:
    """Buckets of all runs of 1 to 4 bytes of one lower-cased text; digits and white space are one byte each."""
    x = np.where((data >= 48) & (data <= 57), 48, np.where(data <= 32, 32, data)).astype(np.uint32)
    found = []
    for size in spec.sizes:
        if len(x) >= size:
            h = np.full(len(x) - size + 1, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for j in range(size):
                h = (h ^ x[j:len(x) - size + 1 + j]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            found.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(spec.buckets).bit_length() + 1)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def has_letter(content: Column) -> Column:
    return F.coalesce(F.rlike(content, F.lit(r"\p{L}")), F.lit(False))


def training_sample(sidecars: DataFrame, key: str, content: str, lang: str, learn_from: Column, spec: LanguageSpec) -> DataFrame:
    """``lang, nth, buckets, counts`` of the first texts of each language in the order of the hash of their keys.

    Keys are counted per language first; only those whose hash lies under a threshold set by the count are put in order, so no
    task holds more than about twice the sample of a language. Where a key has several texts, the one of the least digest counts.
    """
    rows = sidecars.where(learn_from & F.col(lang).isNotNull() & has_letter(F.col(content)))
    keys = pin(rows.select(F.col(lang).alias("lang"), F.col(key).alias("key")).distinct().withColumn("place", F.xxhash64("key")))
    # One row per language: their names are part of the model, which the driver holds.
    totals = pin(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    each = max(1, min(spec.sample, spec.rows // max(totals.count(), 1)))
    share = F.least(F.lit(1.0), (1.5 * each + 50) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("place", F.col("key").cast("string"))
    ids = keys.join(F.broadcast(totals), "lang").where(F.pmod(F.col("place"), F.lit(1 << 40)) <= share * float(1 << 40)) \
        .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("lang", F.col("key").alias("_key"), "nth")
    texts = rows.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(content).cast("string").alias("content"))
    texts = texts.join(F.broadcast(pin(ids).withColumnRenamed("lang", "_lang")), (F.col("lang") == F.col("_lang")) & F.col("key").eqNullSafe(F.col("_key")))

    def run(batches):
        for batch in batches:
            data, offsets = words.text_bytes(batch.column(3))
            pairs = [np.unique(subwords(words.lowered(data[offsets[i]:offsets[i + 1]]), spec), return_counts=True)
                     for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([b for b, _ in pairs], pa.list_(pa.int32())),
                 pa.array([c.astype(np.int32) for _, c in pairs], pa.list_(pa.int32()))], ["lang", "nth", "digest", "buckets", "counts"])

    counted = texts.select("lang", "nth", F.xxhash64("content").alias("digest"), "content") \
        .mapInArrow(words.giving_back(run), "lang string, nth int, digest bigint, buckets array<int>, counts array<int>")
    # The sample has at most ``rows`` rows (or one per language), so one task may sum their sizes; whole ranks are kept up to the bound.
    found = counted.groupBy("lang", "nth").agg(F.min(F.struct("digest", "buckets", "counts")).alias("of"))
    size = F.sum(F.lit(8) * F.size("of.buckets")).over(Window.orderBy("nth"))
    return found.withColumn("size", size).where((F.col("size") <= spec.bytes) | (F.col("nth") == 1)).select("lang", "nth", "of.buckets", "of.counts")


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    """``names``; per bucket the contribution to each language's logit (embedding times output weights); bias,
    temperature and the score below which a prediction is rejected. Its size is bounded by the spec."""

    names: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float

    def scores(self, found: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        weights = counts[:, None] / counts.sum() if counts is not None else 1 / max(len(found), 1)
        return (self.logits[found] * weights).sum(axis=0, dtype=np.float64) + self.bias


def train(sample: pa.Table, spec: LanguageSpec) -> LanguageModel:
    """Stochastic gradient descent in numpy over the bounded sample (embeddings and output weights together)."""
    order = pc.sort_indices(sample.select(["nth", "lang"]), [("nth", "ascending"), ("lang", "ascending")]).to_pylist()
    langs = sample["lang"].to_pylist()
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((spec.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    # Views of the received batches: the sample is not copied.
    views = [[c.values.to_numpy()[c.offsets[i].as_py():c.offsets[i + 1].as_py()] for c in sample[name].chunks for i in range(len(c))]
             for name in ("buckets", "counts")]
    texts = [(views[0][i], views[1][i], names.index(langs[i])) for i in order if len(views[0][i])]
    learn = [t for i, t in enumerate(texts) if i % 5] or texts
    calibrate = texts[::5]
    random = np.random.default_rng(spec.seed)
    vectors = random.normal(0, 1 / spec.dimensions, (spec.buckets, spec.dimensions)).astype(np.float32)
    output, bias = np.zeros((spec.dimensions, len(names))), np.zeros(len(names))
    for epoch in range(spec.epochs):
        rate = spec.rate * (1 - epoch / spec.epochs)
        for at in range(0, len(learn), spec.batch):
            for k in random.permutation(min(spec.batch, len(learn) - at)):
                found, counts, label = learn[at + k]
                share = counts / counts.sum()
                hidden = share @ vectors[found]
                error = softmax(hidden @ output + bias)
                error[label] -= 1
                step = output @ error
                output -= rate * np.outer(hidden, error)
                bias -= rate * 0.1 * error
                vectors[found] -= rate * np.outer(share, step) * 10
    model = LanguageModel(names, (vectors @ output).astype(np.float32), bias, 1.0, 0.0)
    raw, labels = np.array([model.scores(f, c) for f, c, _ in calibrate]), np.array([y for *_, y in calibrate])
    grid = np.exp(np.linspace(np.log(0.3), np.log(20), 61))
    losses = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    best = softmax(raw / model.temperature)
    right = np.sort(best.max(axis=1)[best.argmax(axis=1) == labels])
    if len(right):
        model.least_score = float(right[int(spec.reject * len(right))] * spec.margin)
    return model


def fit_language_model(sidecars: DataFrame, key: str, content: str, lang: str, learn_from: Column,
                       spec: LanguageSpec = LanguageSpec()) -> LanguageModel:
    rows = training_sample(sidecars, key, content, lang, learn_from, spec).toArrow()
    model = train(rows, spec)
    del rows
    pa.default_memory_pool().release_unused()
    return model


def predict(sidecars: DataFrame, model: LanguageModel, content: str, spec: LanguageSpec) -> DataFrame:
    """Adds ``lang_pred, score, accepted`` to the rows; columns that had these names are replaced."""
    sidecars = sidecars.drop("lang_pred", "score", "accepted")
    frame = sidecars.select("*", F.col(content).cast("string").alias("_content"), has_letter(F.col(content)).alias("_letter"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sidecars.schema) \
        + ", lang_pred string, score double, accepted boolean"
    kept = len(sidecars.columns)

    def run(batches):
        for batch in batches:
            data, offsets = words.text_bytes(batch.column(kept))
            letter = batch.column(kept + 1).to_pylist()
            langs, scores = [], []
            for i in range(batch.num_rows):
                if not letter[i] or not model.names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total, n = np.zeros(len(model.names)), 0
                for at in range(int(offsets[i]), int(offsets[i + 1]), words.BLOCK):
                    found = subwords(words.lowered(data[at:min(at + words.BLOCK, int(offsets[i + 1]))]), spec)
                    total += model.logits[found].sum(axis=0, dtype=np.float64)
                    n += len(found)
                chances = softmax((total / max(n, 1) + model.bias) / model.temperature)
                langs.append(model.names[int(chances.argmax())])
                scores.append(float(chances.max()))
            accepted = [lang != "und" and s >= model.least_score for lang, s in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                [*batch.schema.names[:kept], "lang_pred", "score", "accepted"])

    return frame.mapInArrow(words.giving_back(run), schema)


def identify_language(sidecars: DataFrame, key: str = "key", content: str = "content", lang: str = "lang",
                      held_out: Column | None = None, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """One row per sidecar text: ``key, held_out, lang_pred, score, accepted``.

    Sidecars carry no language field in every study, so ``lang`` may be null: the model learns from rows with a value
    that are not ``held_out`` (default: none is), and predicts from the text alone.

    * A null text, or one without a letter, is ``und`` with score 0 and not accepted; so is every text if nothing
      could be learnt. ``accepted`` is false too where the calibrated score is below the rejection threshold.
    * Ties go to the language that sorts first. Repeated rows give repeated results; an empty table an empty one.
    """
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    model = fit_language_model(sidecars, key, content, lang, ~held_out, spec)
    rows = sidecars.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(content).cast("string").alias("content"))
    return predict(rows, model, "content", spec).drop("content")
