"""Benchmark items inside sidecar texts: a BM25 index of the items, block-max WAND per passage, and overlap checks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoq.llm import words
from evoq.session import pin


@dataclass(frozen=True)
class MatchSpec:
    """A passage is a window of ``passage`` words, every ``step`` words (so any run of ``passage - step`` words is whole in one).
    An item is confirmed if the text around the passage holds ``overlap`` of its question's shingles of ``shingle`` words (of a shorter
    question: the whole run) and of its answer's words; it is retrieved from the least BM25 score on that a passage with so
    many of its shingles can have. ``shard`` and ``shard_bytes``: items of one index and their text, bounds on what is broadcast."""

    passage: int = 128
    step: int = 64
    shingle: int = 5
    overlap: float = 0.8
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    rare: float = 0.02
    groups: int = 32
    shard: int = 20_000
    shard_bytes: int = 32 << 20


def word_hashes(text: str | None) -> np.ndarray:
    return next(iter(words.blocks_of_words(pa.array([text or ""])))).hashes


@dataclass
class Postings:
    """Of one term: item numbers in order, their scores, the last item and the best score of every block of postings."""

    items: list[int]
    scores: list[float]
    last: list[int]
    best: list[float]
    top: float


def greatest_loss(scores: np.ndarray, costs: np.ndarray, capacity: float) -> float:
    """The most that terms can score together whose costs add up to ``capacity`` (parts of a term allowed: an upper bound)."""
    order = np.argsort(-scores / costs, kind="stable")
    before = np.concatenate(([0], np.cumsum(costs[order])[:-1]))
    part = np.clip((capacity - before) / costs[order], 0, 1)
    return float((scores[order] * part).sum())


def least_score(question: np.ndarray, score: dict[int, float], spec: MatchSpec) -> float:
    """The least score of a passage that holds ``overlap`` of the question's shingles.

    k shingles that a passage lacks take at most k words with them, as every lost word is in a lost shingle of its own; where shingles
    repeat, a lost word takes all that it is in, and a shingle has ``shingle`` words. Of a question longer than what surely is in one
    passage, some piece of that length lacks no more than its share.
    """
    n = len(question)
    shingles = words.shingles(question, spec.shingle)
    distinct = len(np.unique(shingles))
    lacking = distinct - int(np.ceil(spec.overlap * distinct - 1e-9))

    def of(piece: np.ndarray, capacity: int) -> float:
        terms, counts = np.unique(piece, return_counts=True)
        scores = np.array([score[t] for t in terms.tolist()])
        if distinct < len(shingles):
            at = [np.flatnonzero(question == t) for t in terms]
            counts = np.array([len(np.unique(np.concatenate([shingles[max(i - spec.shingle + 1, 0):i + 1] for i in a]))) for a in at])
            capacity *= spec.shingle
        return float(scores.sum()) - greatest_loss(scores, np.maximum(counts, 1), capacity)

    width = spec.passage - spec.step
    if n <= width:
        return of(question, lacking)
    pieces = n // width
    return min(of(question[k * width:(k + 1) * width], lacking // pieces + spec.shingle - 1) for k in range(pieces))


class ItemIndex:
    """An inverted index of one shard of items with block maxima, and the shingles and answers to verify with."""

    def __init__(self, rows: list[tuple], spec: MatchSpec, n_items: int, mean_words: float, frequency: dict[int, int]):
        self.spec = spec
        self.ids = [r[0] for r in rows]
        questions = [word_hashes(r[1]) for r in rows]
        self.widths = [min(len(q), spec.shingle) for q in questions]
        self.shingles = [np.unique(words.shingles(q, spec.shingle)) for q in questions]
        self.answers = [np.unique(word_hashes(r[2])) for r in rows]
        postings: dict[int, list[tuple[int, float]]] = {}
        self.needed = np.full(len(rows), np.inf)
        for i, q in enumerate(questions):
            terms, counts = np.unique(q, return_counts=True)
            score = {}
            for t, n in zip(terms.tolist(), counts.tolist()):
                df = frequency.get(t, 1)
                idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
                score[t] = float(idf * n * (spec.k1 + 1) / (n + spec.k1 * (1 - spec.b + spec.b * len(q) / mean_words)))
                postings.setdefault(t, []).append((i, score[t]))
            if len(q):
                self.needed[i] = max(least_score(q, score, spec), 0.0)
        self.terms = np.array(sorted(postings), np.uint64)
        self.lists = []
        for t in self.terms.tolist():
            items, scores = [i for i, _ in postings[t]], [s for _, s in postings[t]]
            cut = range(0, len(items), spec.block)
            self.lists.append(Postings(items, scores, [items[min(k + spec.block, len(items)) - 1] for k in cut],
                                       [max(scores[k:k + spec.block]) for k in cut], max(scores)))
        # What an item can get from terms that many items hold is known beforehand, so a passage is looked up only if
        # the rare terms in it can bring some group of items the rest of what is needed there. Groups are a fixed number.
        rare = np.array([len(p.items) <= max(1, spec.rare * len(rows)) for p in self.lists], bool)
        common = np.zeros(len(rows))
        for p in (p for p, r in zip(self.lists, rare) if not r):
            common[p.items] += p.scores
        rest = self.needed - common
        group = np.empty(len(rows), np.int64)
        group[np.argsort(rest, kind="stable")] = np.arange(len(rows)) * spec.groups // max(len(rows), 1)
        self.group_needs = np.full(spec.groups, np.inf)
        np.minimum.at(self.group_needs, group, rest)
        self.rare_at = np.full(len(self.terms) + 1, -1, np.int64)
        self.rare_at[:-1][rare] = np.arange(rare.sum())
        self.bounds = np.zeros((int(rare.sum()), spec.groups), np.float32)
        for row, p in enumerate(p for p, r in zip(self.lists, rare) if r):
            np.maximum.at(self.bounds[row], group[p.items], np.array(p.scores, np.float32))

    def search(self, terms: list[int]) -> list[int]:
        """Items that reach their needed score for a passage of distinct terms, by block-max WAND.

        Cursors stand in item order. The pivot is the first item at which the summed best scores reach the least
        score needed; if the blocks' best scores there do not reach it, all cursors up to it move past these blocks.
        """
        lists = [self.lists[t] for t in terms]
        least = float(self.needed.min()) - 1e-6
        at, block, found = [0] * len(lists), [0] * len(lists), []
        heap = [(p.items[0], k) for k, p in enumerate(lists)]
        heapq.heapify(heap)

        def advance(k: int, item: int) -> None:
            p = lists[k]
            while block[k] < len(p.last) and p.last[block[k]] < item:
                block[k] += 1
            at[k] = max(at[k], block[k] * self.spec.block)
            while at[k] < len(p.items) and p.items[at[k]] < item:
                at[k] += 1
            if at[k] < len(p.items):
                heapq.heappush(heap, (p.items[at[k]], k))

        while heap:
            taken, bound, pivot = [], 0.0, None
            while heap:
                item, k = heapq.heappop(heap)
                taken.append((item, k))
                bound += lists[k].top
                if bound >= least:
                    pivot = item
                    break
            if pivot is None:
                break
            while heap and heap[0][0] == pivot:
                taken.append(heapq.heappop(heap))
            tight, beyond = 0.0, 1 << 60
            for _, k in taken:
                p, b = lists[k], block[k]
                while b < len(p.last) and p.last[b] < pivot:
                    b += 1
                block[k] = b
                if b < len(p.last):
                    tight += p.best[b]
                    beyond = min(beyond, p.last[b] + 1)
            if tight < least:
                if heap:
                    beyond = min(beyond, heap[0][0])
                for _, k in taken:
                    advance(k, max(beyond, pivot + 1))
                continue
            score = 0.0
            for item, k in taken:
                advance(k, pivot)
            while heap and heap[0][0] == pivot:
                _, k = heapq.heappop(heap)
                score += lists[k].scores[at[k]]
                advance(k, pivot + 1)
            if score >= self.needed[pivot] - 1e-6:
                found.append(pivot)
        return found

    def passages(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Windows of one text whose bounds reach what some group of items needs."""
        n, spec = len(hashes), self.spec
        starts = np.arange(0, max(n - spec.step, 1), spec.step)
        ends = np.minimum(starts + spec.passage, n)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        code = np.where(self.terms[at] == hashes, at, len(self.terms))
        # A window is some steps, so sums over steps are enough; a repeated word counts twice, which only raises the bound.
        rare = np.flatnonzero(self.rare_at[code] >= 0)
        steps, sums = spec.passage // spec.step, np.zeros((len(starts) + spec.passage // spec.step, spec.groups), np.float32)
        if len(rare):
            own, first = np.unique(rare // spec.step, return_index=True)
            sums[own] = np.add.reduceat(self.bounds[self.rare_at[code[rare]]], first, axis=0)
        total = sum(sums[j:j + len(starts)] for j in range(steps))
        kept = np.flatnonzero((total >= self.group_needs - 1e-3).any(axis=1))
        return list(zip(starts[kept].tolist(), ends[kept].tolist()))

    def matches(self, hashes: np.ndarray) -> dict[int, float]:
        """Confirmed items of one text with the best share of question shingles found."""
        spec, out = self.spec, {}
        if not len(self.terms) or not len(hashes):
            return out
        for a, b in self.passages(hashes):
            window = np.unique(hashes[a:b])
            at = np.searchsorted(self.terms, window)
            at[at == len(self.terms)] = 0
            for i in self.search(at[self.terms[at] == window].tolist()):
                size = len(self.shingles[i]) + spec.shingle
                around = hashes[max(a - size, 0):b + size]
                held = np.isin(self.shingles[i], words.shingles(around, self.widths[i]), assume_unique=False).mean()
                if held < spec.overlap:
                    continue
                if len(self.answers[i]) and np.isin(self.answers[i], around).mean() < spec.overlap:
                    continue
                out[i] = max(out.get(i, 0.0), float(held))
        return out


def _index_tables(items: DataFrame, item: str, question: str, answer: str | None) -> DataFrame:
    columns = [F.col(item).alias("item"), F.col(question).cast("string").alias("question"),
               (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")]
    return items.select(*columns).where("item is not null").distinct()


def contaminated(sidecars: DataFrame, items: DataFrame, key: str = "key", content: str = "content", item: str = "item",
                 question: str = "question", answer: str | None = "answer", spec: MatchSpec = MatchSpec()) -> DataFrame:
    """``key, item, overlap``: one row per sidecar text and benchmark item that the text holds.

    Studies publish no benchmark of their own, so ``items`` is any table of questions with answers (``answer`` may be None or
    null: only the question is verified then). Every passage of every whole text queries a BM25 index of the
    questions by block-max WAND; all items that reach their threshold are retrieved and verified.

    The index is built per shard of about ``shard`` items or ``shard_bytes`` of text, broadcast one after another: its size is bounded
    however many items there are. The word statistics are those of all items.

    * Null or empty texts match nothing; an item without a word in its question is never matched; one of fewer than five
      words is found wherever these words follow each other. Rows without a key keep their null key.
    * Equal items are one; items that share an id are each searched and give one row with the larger overlap.
    * Repeated rows give repeated results; empty tables give an empty one. Other columns are ignored.
    """
    table = pin(_index_tables(items, item, question, answer))
    n_items, size = table.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()
    kind, item_kind = sidecars.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    item_type = items.schema[item].dataType
    schema = f"key {kind}, item {item_kind}, overlap double"
    texts = sidecars.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content"))
    spark = sidecars.sparkSession
    if not n_items:
        return spark.createDataFrame([], schema)
    shards = max(1, -(-n_items // spec.shard), -(-(size or 0) // spec.shard_bytes))
    placed = table.withColumn("shard", F.pmod(F.xxhash64("item", "question", "answer"), F.lit(shards)))
    terms = pin(placed.select("shard", "question").mapInArrow(words.giving_back(_terms_of), "shard bigint, term bigint, n bigint"))
    held = F.sum(F.when(F.col("term").isNull(), F.col("n")))
    mean = (terms.agg(held).first()[0] or 0) / n_items
    frequency = pin(terms.where("term is not null").groupBy("term").count())
    out = None
    for s in range(shards):
        rows = [tuple(r) for r in placed.where(F.col("shard") == s).select("item", "question", "answer").orderBy("item", "question", "answer").collect()]
        own = frequency.join(terms.where((F.col("shard") == s) & F.col("term").isNotNull()).select("term").distinct(), "term").toArrow()
        known = dict(zip(own["term"].to_numpy().view(np.uint64).tolist(), own["count"].to_pylist()))
        # By value, so that executors need not have this package.
        index = spark.sparkContext.broadcast(cloudpickle.dumps(ItemIndex(rows, spec, n_items, max(mean, 1.0), known)))
        found = texts.mapInArrow(words.giving_back(_matcher(index, item_type)), schema)
        out = found if out is None else out.union(found)
    return out if shards == 1 else out.groupBy("key", "item").agg(F.max("overlap").alias("overlap"))


def _terms_of(batches):
    """``shard, term, n``: a row per distinct word of each question, and one without a term that has the number of its words."""
    for batch in batches:
        shards, terms, counts = [], [], []
        for shard, question in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hashes = word_hashes(question)
            found = np.unique(hashes).view(np.int64).tolist()
            shards += [shard] * (len(found) + 1)
            terms += [*found, None]
            counts += [*[1] * len(found), len(hashes)]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], ["shard", "term", "n"])


def _matcher(shared, item_type: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(item_type)

    def run(batches):
        index = None
        for batch in batches:
            index = index or cloudpickle.loads(shared.value)
            rows, items, overlaps = [], [], []
            for block in words.blocks_of_words(batch.column(1)):
                for i in range(block.last - block.first):
                    best: dict = {}
                    for k, held in index.matches(block.hashes[block.rows[i]:block.rows[i + 1]]).items():
                        best[index.ids[k]] = max(best.get(index.ids[k], 0.0), held)
                    for k, held in best.items():
                        rows.append(block.first + i)
                        items.append(k)
                        overlaps.append(held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, arrow),
                                              pa.array(overlaps, pa.float64())], ["key", "item", "overlap"])

    return run
