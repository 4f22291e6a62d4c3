"""Context-tree weighting of sidecar texts: byte contexts, binary-decomposed, mixed over all depths."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.llm import words
from evoq.session import pin


@dataclass(frozen=True)
class TreeSpec:
    """``depth``: bytes of context. ``head`` and ``gram_head``: at most so many frequent words and grams are looked up in a table of
    fixed size, all others by a join. ``slots``: log2 of the places of ``model_table``, which takes no part in the scores."""

    depth: int = 4
    slots: int = 23
    head: int = 1 << 16
    gram_head: int = 1 << 19


def token_bytes(block: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows' tokens: words parted by a space, then the end byte (a line feed); and where each row begins."""
    sizes = block.ends - block.starts
    gaps = np.ones(len(sizes), np.int64)
    n_rows = block.last - block.first
    per_row = np.diff(block.rows)
    # A word takes its bytes and one more: the space after it or, after the last word, the end. An empty row is the end only.
    lengths = np.zeros(n_rows, np.int64)
    np.add.at(lengths, np.repeat(np.arange(n_rows), per_row), sizes + gaps)
    lengths[per_row == 0] = 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(int(begins[-1]), 32, np.uint8)
    out[begins[1:] - 1] = 10
    if len(sizes):
        row = np.repeat(np.arange(n_rows), per_row)
        before = np.cumsum(sizes + gaps) - (sizes + gaps)
        base = np.zeros(n_rows, np.int64)
        full = per_row > 0
        base[full] = before[block.rows[:-1][full]]
        place = begins[:-1][row] + before - base[row]
        starts = np.cumsum(sizes) - sizes
        inner = np.arange(int(sizes.sum()))
        out[np.repeat(place - starts, sizes) + inner] = block.data[np.repeat(block.starts - starts, sizes) + inner]
    return out, begins


def grams(data: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Every byte with the ``depth`` bytes before it (0 before the row's start), packed with the byte lowest."""
    out = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(begins[:-1], np.diff(begins))
    for d in range(1, depth + 1):
        before = np.zeros(len(data), np.uint64)
        before[d:] = data[:-d]
        before[place < d] = 0
        out |= before << np.uint64(8 * d)
    return out


class Sums:
    """Counts of 64-bit keys, merged now and then and given out before they grow large."""

    def __init__(self, limit: int = 1 << 21):
        self.keys, self.counts, self.held, self.limit = [], [], 0, limit

    def add(self, keys: np.ndarray) -> bool:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * self.limit:
            self.merge()
        return self.held > self.limit and len(self.keys) == 1

    def merge(self) -> None:
        keys = np.concatenate(self.keys)
        order = np.argsort(keys)
        keys, counts = keys[order], np.concatenate(self.counts)[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first)]
        self.held = len(first)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.merge()
        out = self.keys[0], self.counts[0]
        self.keys, self.counts, self.held = [], [], 0
        return out


def corpus_counts(sidecars: DataFrame, content: str, learn_from: Column, depth: int) -> DataFrame:
    """``kind, item, n``: word counts (kind 0, by word hash), context and byte counts (kind 1) and the number of texts (kind 2)
    of the rows learnt from, summed per task."""

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
                                           pa.array(counts.astype(np.int64))], ["kind", "item", "n"])

    def run(batches):
        sums, texts = (Sums(), Sums()), 0
        for batch in batches:
            texts += batch.num_rows
            for block in words.blocks_of_words(batch.column(0)):
                data, begins = token_bytes(block)
                for kind, found in ((0, block.hashes), (1, grams(data, begins, depth))):
                    if len(found) and sums[kind].add(found):
                        yield rows(kind, *sums[kind].take())
        for kind in (0, 1):
            yield rows(kind, *sums[kind].take())
        yield rows(2, np.zeros(1, np.uint64), np.array([texts]))

    return sidecars.where(learn_from).select(F.col(content).cast("string").alias("content")) \
        .mapInArrow(run, "kind int, item bigint, n bigint")


def log_gamma(x: Column) -> Column:
    """Stirling's series after six steps up; good to 1e-10 for the half and whole numbers used here."""
    y = x + 6
    up = F.ln(x) + F.ln(x + 1) + F.ln(x + 2) + F.ln(x + 3) + F.ln(x + 4) + F.ln(x + 5)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) \
        + 1 / (1260 * y * y * y * y * y) - up


def tree_nodes(gram_counts: DataFrame, depth: int) -> DataFrame:
    """``depth, context, prefix, ones, zeros, stop``: every node of the tree with its bit counts and ``stop``, the log odds that
    the node predicts itself rather than its children.

    A node is a context of whole bytes and the bits of the next byte known so far (``prefix``, led by a 1). The deepest
    nodes come from the counts; each level above adds up its children, so every step is one grouped sum.
    """
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")
    byte = F.col("item").bitwiseAND(255).cast("int")
    leaf = gram_counts.select("item", "n", bits).select(
        F.shiftrightunsigned("item", 8).alias("context"), F.expr("(1 << bit) | shiftright(cast(item & 255 as int), 8 - bit)").alias("prefix"),
        (F.expr("shiftright(cast(item & 255 as int), 7 - bit) & 1") * F.col("n")).alias("ones"), F.col("n").alias("all"))
    level = leaf.groupBy("context", "prefix").agg(F.sum("ones").alias("ones"), (F.sum("all") - F.sum("ones")).alias("zeros"))
    level = level.withColumn("below", F.lit(None).cast("double"))
    out = None
    for d in range(depth, -1, -1):
        kt = log_gamma(F.col("ones") + 0.5) + log_gamma(F.col("zeros") + 0.5) - log_gamma(F.col("ones") + F.col("zeros") + 1.0) - math.log(math.pi)
        level = level.withColumn("kt", kt).withColumn("stop", F.col("kt") - F.col("below"))
        weighted = F.when(F.col("below").isNull(), F.col("kt")).otherwise(
            math.log(0.5) + F.greatest("kt", "below") + F.log1p(F.exp(-F.abs(F.col("stop")))))
        level = pin(level.select("context", "prefix", "ones", "zeros", F.coalesce("stop", F.lit(1e9)).alias("stop"), weighted.alias("log_p")))
        part = level.select(F.lit(d).alias("depth"), "context", "prefix", "ones", "zeros", "stop")
        out = part if out is None else out.union(part)
        if d:
            shorter = F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1)
            level = level.groupBy(shorter.alias("context"), "prefix").agg(
                F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.sum("log_p").alias("below"))
    return out


MULTIPLIERS = tuple(int(x) for x in words.mix(np.arange(1, 3, dtype=np.uint64)) | np.uint64(1))


def node_places(contexts: np.ndarray, prefixes: np.ndarray, depth: int, slots: int) -> np.ndarray:
    key = (contexts * np.uint64(MULTIPLIERS[0])) ^ ((prefixes.astype(np.uint64) + np.uint64(depth * 256)) * np.uint64(MULTIPLIERS[1]))
    return (words.mix(key) >> np.uint64(64 - slots)).astype(np.int64)


def model_table(nodes: DataFrame, spec: TreeSpec) -> tuple[np.ndarray, np.ndarray]:
    """Chance of a one and weight of the node itself for every place (NaN where no node is): 8 bytes times ``2**slots``.

    The nodes are placed and averaged in Spark; at most one row per place reaches the driver.
    """
    slots = spec.slots

    def place(batches):
        for batch in batches:
            depth, context, prefix, ones, zeros, stop = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = np.zeros(len(depth), np.int64)
            for d in np.unique(depth):
                own = depth == d
                at[own] = node_places(context[own].astype(np.uint64), prefix[own], int(d), slots)
            n = (ones + zeros).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(n), pa.array(n * (ones + 0.5) / (n + 1)), pa.array(n / (1 + np.exp(-np.clip(stop, -700, 700))))],
                ["place", "n", "one", "own"])

    placed = nodes.mapInArrow(place, "place bigint, n double, one double, own double").groupBy("place").agg(
        (F.sum("one") / F.sum("n")).cast("float").alias("one"), (F.sum("own") / F.sum("n")).cast("float").alias("own"))
    table = placed.toArrow()
    one, own = (np.full(1 << slots, np.nan, np.float32) for _ in range(2))
    at = table["place"].to_numpy()
    one[at], own[at] = table["one"].to_numpy(), table["own"].to_numpy()
    return one, own


def gram_scores(keys: np.ndarray, one: np.ndarray, own: np.ndarray, depth: int, slots: int) -> np.ndarray:
    """log10 of the chance of each byte after its context: per bit, the estimates of all depths mixed from the deepest
    node seen up to the root. A context never seen has no say."""
    total = np.zeros(len(keys))
    byte = (keys & np.uint64(255)).astype(np.int64)
    for bit in range(8):
        prefix = (1 << bit) | (byte >> (8 - bit))
        mixed = np.full(len(keys), 0.5)
        seen = np.zeros(len(keys), bool)
        for d in range(depth, -1, -1):
            at = node_places((keys >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1), prefix, d, slots)
            p, w = one[at].astype(np.float64), own[at].astype(np.float64)
            there = ~np.isnan(p)
            mixed = np.where(there, np.where(seen, w * p + (1 - w) * mixed, p), mixed)
            seen |= there
        is_one = (byte >> (7 - bit)) & 1 == 1
        total += np.log10(np.where(is_one, mixed, 1 - mixed))
    return total


def node_chances(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """For every depth ``context, prefix, chance``: that of a one if the node is the deepest one seen, the estimates of the nodes
    above it mixed in. Each level is joined with the one above it."""
    out: list[DataFrame] = []
    for d in range(depth + 1):
        p = (F.col("ones") + 0.5) / (F.col("ones") + F.col("zeros") + 1.0)
        own = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("stop")))))
        level = nodes.where(F.col("depth") == d).select("context", "prefix", p.alias("p"), own.alias("own"))
        if d:
            above = out[-1].select(F.col("context").alias("shorter"), "prefix", "above", "left")
            level = level.withColumn("shorter", F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1)).join(above, ["shorter", "prefix"])
        else:
            level = level.withColumn("above", F.lit(0.0)).withColumn("left", F.lit(1.0))
        out.append(pin(level.select("context", "prefix", (F.col("above") + F.col("left") * F.col("p")).alias("chance"),
                                    (F.col("above") + F.col("left") * F.col("own") * F.col("p")).alias("above"),
                                    (F.col("left") * (1 - F.col("own"))).alias("left"))))
    return out


def gram_chances(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``item, n, score``: log10 of the chance of each gram's byte after its context; per bit that of the deepest node seen."""
    byte = "cast(item & 255 as int)"
    rest = grams.select("item", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).select(
        "item", "n", F.expr(f"(1 << bit) | shiftright({byte}, 8 - bit)").alias("prefix"), F.expr(f"shiftright({byte}, 7 - bit) & 1 = 1").alias("is_one"))
    found = None
    for d in range(len(levels) - 1, -1, -1):
        at = F.shiftrightunsigned("item", 8).bitwiseAND((1 << 8 * d) - 1)
        looked = pin(rest.withColumn("context", at).join(levels[d].select("context", "prefix", "chance"), ["context", "prefix"], "left"))
        part = looked.where("chance is not null").select("item", "n", "is_one", "chance")
        found = part if found is None else found.union(part)
        rest = looked.where("chance is null").select("item", "n", "prefix", "is_one")
    found = found.union(rest.select("item", "n", "is_one", F.lit(0.5).alias("chance")))
    chance = F.when(F.col("is_one"), F.col("chance")).otherwise(1 - F.col("chance"))
    return found.groupBy("item").agg(F.first("n").alias("n"), F.sum(F.log10(chance)).alias("score"))


def frequent_grams(scores: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and scores of the grams that occur at least 2**k times, with the least k that gives at most ``most``."""
    power = F.floor(F.log2("n")).cast("int")
    held, least = 0, None
    for k, n in sorted(((r[0], r[1]) for r in scores.groupBy(power.alias("k")).agg(F.count(F.lit(1))).collect()), reverse=True):
        held += n
        if held > most:
            break
        least = k
    table = scores.where(power >= (64 if least is None else least)).select("item", "score").toArrow()
    keys = table["item"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["score"].to_numpy()[order]


class GramTable:
    """Looks up the frequent grams' scores: by a place each, and those that lost theirs by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        self.keys, self.values, self.shift = keys, values, np.uint64(64 - bits)
        self.at = np.zeros(1 << bits, np.int32)
        self.at[self.place(keys)] = np.arange(len(keys), dtype=np.int32)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(MULTIPLIERS[0]) >> self.shift).astype(np.int64)

    def scores(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are known, and the scores (0 for the others)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = self.at[self.place(keys)].astype(np.int64)
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.minimum(np.searchsorted(self.keys, keys[missed]), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, np.where(known, self.values[at], 0.0)


def _times(row: np.ndarray, items: np.ndarray, n: int) -> pa.ListArray:
    """Distinct items of each of ``n`` rows with how often they occur."""
    order = np.lexsort((items, row))
    row, items = row[order], items[order]
    fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (items[1:] != items[:-1])])) if len(row) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([fresh, [len(row)]])).astype(np.int32)
    ends = pa.array(np.searchsorted(row[fresh], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(items[fresh].view(np.int64)), pa.array(times)], ["item", "times"]))


def tree_scores(sidecars: DataFrame, key: str = "key", content: str = "content", held_out: Column | None = None,
                spec: TreeSpec = TreeSpec()) -> DataFrame:
    """One row per sidecar text: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Tokens are the lower-cased (A-Z) words of the whole text and one end. Rows that are not ``held_out`` (default:
    none is) are learnt from; ``base_score`` is the add-one word score, ``score`` the log10 probability of the text's
    tokens, spelt with single spaces and an end byte, under context-tree weighting: for every bit of every byte the
    Krichevsky-Trofimov estimates of the contexts of 0 to ``depth`` bytes, mixed by the weights that the whole
    training corpus gives them. ``bits_per_byte`` is its code length.

    * A null or empty text is the end alone. If nothing is learnt from, N and V are 0 and all bits have chance 1/2.
    * Every row gives one row, repeated ones included; an empty table an empty one. Other columns are ignored.
    """
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    counts = pin(corpus_counts(sidecars, content, ~held_out, spec.depth).groupBy("kind", "item").agg(F.sum("n").alias("n")))
    word_counts = counts.where("kind = 0").select("item", "n")
    totals = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    train_tokens, distinct = totals["n"] + texts, totals["v"] + (texts > 0)
    unit = math.log10(train_tokens + distinct + 1)
    head = pin(word_counts.orderBy(F.desc("n"), "item").limit(spec.head)).toArrow()
    order = np.argsort(head["item"].to_numpy().view(np.uint64))
    head_words, head_counts = head["item"].to_numpy().view(np.uint64)[order], head["n"].to_numpy()[order]
    learnt = counts.where("kind = 1").select("item", "n")
    levels = node_chances(tree_nodes(learnt, spec.depth), spec.depth)
    others = corpus_counts(sidecars, content, held_out, spec.depth).where("kind = 1").select("item", "n")
    scores = pin(gram_chances(learnt.union(others).groupBy("item").agg(F.sum("n").alias("n")), levels))
    shared = sidecars.sparkSession.sparkContext.broadcast((head_words, head_counts, *frequent_grams(scores, spec.gram_head)))
    end_score = math.log10(texts + 1) - unit
    kind, depth = sidecars.schema[key].dataType.simpleString(), spec.depth

    def run(batches):
        head_words, head_counts, *table = shared.value
        table = GramTable(*table)
        for batch in batches:
            for block in words.blocks_of_words(batch.column(2)):
                n = block.last - block.first
                row = np.repeat(np.arange(n), np.diff(block.rows))
                at = np.minimum(np.searchsorted(head_words, block.hashes), max(len(head_words) - 1, 0))
                known = head_words[at] == block.hashes if len(head_words) else np.zeros(len(block.hashes), bool)
                base = np.bincount(row[known], np.log10(head_counts[at[known]] + 1.0), n) if known.any() else np.zeros(n)
                data, begins = token_bytes(block)
                keys = grams(data, begins, depth)
                held, score = table.scores(keys)
                score = np.add.reduceat(score, begins[:-1])
                byte_row = np.repeat(np.arange(n), np.diff(begins))
                # The other words and grams, once per row with their counts.
                rest, rest_grams = _times(row[~known], block.hashes[~known], n), _times(byte_row[~held], keys[~held], n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, n), batch.column(1).slice(block.first, n),
                     pa.array(np.diff(block.rows).astype(np.int64) + 1), pa.array(np.bincount(row[known], minlength=n).astype(np.int64)),
                     pa.array(base), pa.array(score), pa.array(np.diff(begins).astype(np.int64)), rest, rest_grams],
                    ["key", "held_out", "n_tokens", "n_head", "head_score", "score", "n_bytes", "rest", "rest_grams"])

    scored = sidecars.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(content).cast("string").alias("content")) \
        .mapInArrow(run, f"key {kind}, held_out boolean, n_tokens bigint, n_head bigint, head_score double, score double, "
                         "n_bytes bigint, rest array<struct<item: bigint, times: int>>, rest_grams array<struct<item: bigint, times: int>>")
    scored = pin(scored.withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode("rest").alias("w")).select("row", "w.item", "w.times")
    tail = rest.join(word_counts, "item").groupBy("row").agg(
        F.sum("times").alias("n_tail"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_score"))
    rare = scored.select("row", F.explode("rest_grams").alias("w")).select("row", "w.item", "w.times").join(scores, "item") \
        .groupBy("row").agg(F.sum(F.col("times") * F.col("score")).alias("rare_score"))
    whole = scored.drop("rest", "rest_grams").join(tail, "row", "left").join(rare, "row", "left") \
        .withColumn("score", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    return whole.select(
        "key", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(int(texts > 0))).cast("bigint").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0)) - (F.col("n_tokens") - 1) * F.lit(unit) + F.lit(end_score)).alias("base_score"),
        "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
