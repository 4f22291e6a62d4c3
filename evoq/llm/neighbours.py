"""Exact nearest trials by inner product of their feature vectors: KD-trees per shard, best-first search."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoq.session import pin


@dataclass(frozen=True)
class SearchSpec:
    """``shard`` trials per tree and ``block`` queries per search: the bounds on what a task holds."""

    k: int = 10
    scale: int = 1024
    shard: int = 8192
    block: int = 4096
    leaf: int = 64


class Tree:
    """A KD-tree: the widest dimension is split at the median, every node knows the tight box of its points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int):
        self.lows, self.highs, self.children, self.spans = [], [], [], []
        order, at = np.arange(len(points)), 0
        todo = [(0, len(points), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            own = points[order[begin:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            node = len(self.lows)
            self.lows.append(low)
            self.highs.append(high)
            self.children.append([-1, -1])
            self.spans.append((begin, end))
            if parent >= 0:
                self.children[parent][side] = node
            if end - begin > leaf and (high > low).any():
                axis, middle = int((high - low).argmax()), (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, axis], middle)]
                todo += [(begin, begin + middle, node, 0), (begin + middle, end, node, 1)]
        self.ids, self.points = ids[order], points[order]
        self.lows, self.highs = np.array(self.lows), np.array(self.highs)

    def search(self, own_id, query: np.ndarray, k: int, least) -> list[tuple]:
        """Best ``(score, id)``, not of ``own_id``, at or above ``least``: nodes in the order of the greatest score in their box,
        until that is under the k-th score."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bounds = self.highs @ up + self.lows @ down
        heap, best = [(-bounds[0], 0)], []
        kth = least
        while heap:
            bound, node = heapq.heappop(heap)
            if kth is not None and -bound < kth:
                break
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            begin, end = self.spans[node]
            scores = self.points[begin:end] @ query
            for i in range(end - begin) if kth is None else np.flatnonzero(scores >= kth).tolist():
                if self.ids[begin + i] != own_id:
                    best.append((scores[i], self.ids[begin + i]))
            if len(best) >= k:
                best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
                kth = best[-1][0]
        return sorted(best, key=lambda x: (-x[0], x[1]))[:k]


def numbers(vectors: list, largest: int) -> np.ndarray:
    """Rows of whole numbers: floats where every inner product is exact in them, else Python's integers."""
    dims = len(vectors[0]) if len(vectors) else 0
    exact = max(largest, 1) ** 2 * max(dims, 1) < 2**53
    rows = [list(v) if exact else [int(x) for x in v] for v in vectors]
    return np.array(rows, dtype=np.float64 if exact else object).reshape(len(vectors), dims)


def _searcher(spec: SearchSpec):
    k, leaf = spec.k, spec.leaf

    def run(key, queries: pd.DataFrame, trials: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(trials):
            largest = max(max((abs(int(x)) for v in side for x in (min(v), max(v))), default=0) for side in (queries["vector"], trials["vector"]))
            trials = trials.sort_values("key")
            tree = Tree(trials["key"].to_numpy(), numbers(trials["vector"].tolist(), largest), leaf)
            points = numbers(queries["vector"].tolist(), largest)
            for i, (own, least) in enumerate(zip(queries["query_key"], queries["kth"])):
                least = None if pd.isna(least) else int(least)
                rows += [(own, found, int(score)) for score, found in tree.search(own, points[i], k, least)]
        return pd.DataFrame(rows, columns=["query_key", "key", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_trials(trials: DataFrame, is_query: Column, key: str = "epoch", vector: str = "features",
                   spec: SearchSpec = SearchSpec()) -> DataFrame:
    """``query_key, rank, key, score``: of every query the ``k`` other trials with the highest scores, ties to the smaller key.

    ``trials`` are rows of a feature table with a key and a feature array; components are taken as floor(1024 * x) and a
    score is the whole-number inner product. Each shard of trials is a KD-tree. A query first searches the shard it
    falls in; its k-th score so far goes along to all other shards, whose boxes below it are never opened. The result
    is exact.

    Queries are a stated set of rows (``is_query``) searched against all rows, block by block: shards and blocks have a
    fixed size, each pair of them is one task group.

    * A vector that is null, empty, or holds a null, a non-finite or a component beyond 64 bits takes no part, nor does
      a null key. Vectors are only compared with those of as many components.
    * Of rows that repeat a key the least vector stands for it. Fewer than ``k`` others give all; scores beyond 64 bits
      raise an error. An empty table gives an empty one. Other columns are ignored.
    """
    kind = trials.schema[key].dataType.simpleString()
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * spec.scale)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x)))
    rows = trials.select(F.col(key).alias("key"), whole.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")) \
        .where("key is not null and size(vector) > 0 and not exists(vector, x -> x is null)")
    rows = pin(rows.groupBy("key").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query"))
               .withColumn("dims", F.size("vector")))
    shards = max(1, -(-rows.count() // spec.shard))
    blocks = max(1, -(-rows.where("is_query").count() // spec.block))
    home = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = rows.select("key", "vector", "dims", home.alias("shard")).withColumn("block", spread(blocks))
    queries = rows.where("is_query").select(F.col("key").alias("query_key"), F.col("vector").alias("vector"), F.col("dims").alias("dims"), home.alias("home"),
                                            F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    group, schema = ["dims", "shard", "block"], f"query_key {kind}, key {kind}, score bigint"

    def search(some: DataFrame) -> DataFrame:
        return some.groupBy(*group).cogroup(points.groupBy(*group)).applyInPandas(_searcher(spec), schema)

    first = pin(search(queries.withColumnRenamed("home", "shard").withColumn("kth", F.lit(None).cast("bigint"))))
    reached = first.groupBy("query_key").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")) \
        .select("query_key", F.when(F.col("n") >= spec.k, F.col("kth")).alias("kth"))
    others = queries.join(reached, "query_key", "left").withColumn("shard", spread(shards)).where("shard <> home").drop("home")
    return _best(first.union(search(others)), spec.k).select("query_key", "rank", "key", "score")
