"""Feature ranking: random forest, impurity and permutation importance, comparison of two targets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoq.config import NON_FEATURES
from evoq.functions.trees import grow, predict_sum, predict_swapped_sum
from evoq.operators import summaries
from evoq.operators.ranking import digest_position, keyed_permutation, shuffle_digest
from evoq.session import pin, scratch_path
from evoq.sources.stores import store_of

# Targets are learnt as whole numbers of this unit: their sums are exact, so no order of rows or tasks shows in a tree.
UNIT = 2.0 ** -20
# Nodes of the trees that a task holds at once, some 40 bytes each, and rows that it takes past them together.
SHARD_NODES, BLOCK_ROWS = 1_000_000, 32_768


@dataclass(frozen=True)
class ForestSpec:
    """Full trees over all features, as the library of the analysis grows them.

    Every tree is fitted on a bootstrap of all training rows: as many draws as there are rows, or at most ``rows_per_tree`` of them
    where that is given. ``bins``: at most so many distinct values of a feature in a tree (None: all).
    """

    trees: int = 300
    depth: int = 60
    bins: int | None = None
    seed: int = 42
    test_share: float = 0.2
    repeats: int = 15
    rows_per_tree: int | None = None


@dataclass(frozen=True)
class Forest:
    """``trees``: a row per tree with its nodes as arrays (see ``grow``), in the shared folder; ``shards``: ranges of tree numbers
    whose nodes a task holds at once; ``files``: the file of each tree, from which the tasks read it."""

    trees: DataFrame
    shards: list[tuple[int, int]]
    n_trees: int
    files: dict[int, str]


def feature_names(columns: list[str], drop: tuple[str, ...] = NON_FEATURES) -> list[str]:
    return [c for c in columns if c not in drop]


def labelled(features: DataFrame, subset: tuple[str, ...] = ("rating", "laser_power")) -> DataFrame:
    return features.na.drop(subset=list(subset))


def model_inputs(features: DataFrame) -> tuple[DataFrame, list[str]]:
    """Labelled rows with the remaining gaps filled by column medians, and the names of the model inputs.

    A feature without a single value, such as the phase locking of a pair no montage has, is not an input.
    """
    rows, names = labelled(features), feature_names(features.columns)
    held = rows.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in names]).first()
    empty = [n for n in names if not held[n]]
    names = [n for n in names if held[n]]
    return summaries.impute_medians(rows.drop(*empty), names), names


def split(df: DataFrame, key: list[str], seed: int = 42, test_share: float = 0.2) -> DataFrame:
    """Adds ``position`` (1..n in a seeded random order) and ``is_test``: exactly ceil(share * n) test rows.

    Test rows are the first positions, so they are numbered without a gap.
    """
    digest = shuffle_digest(seed, *[F.col(k) for k in key])
    placed = digest_position(df.withColumn("_d", digest), "_d")
    return placed.withColumn("is_test", F.col("position") <= F.ceil(F.col("group_size") * test_share)) \
        .drop("_d", "group_size")


def draws(spec: ForestSpec, n: Column) -> DataFrame:
    """``tree, place, weight``: how often the row at ``place`` (1..n) is drawn for each tree, of n draws (``rows_per_tree``: at most that many).

    Which row a draw takes is a digest of seed, tree and number of the draw, whatever the partitions. The trees are dealt before
    their draws are made, so a tree's draws are made and counted by one task and none of them is shuffled.
    """
    size = (n if spec.rows_per_tree is None else F.least(n, F.lit(spec.rows_per_tree))).cast("bigint")
    trees = SparkSession.active().range(1, spec.trees + 1).select(F.col("id").alias("tree")).repartition(spec.trees, "tree")
    every = trees.select("tree", F.explode(F.sequence(F.lit(1).cast("bigint"), size)).alias("draw"))
    picked = F.conv(F.substring(shuffle_digest(spec.seed, F.col("tree"), F.col("draw")), 1, 12), 16, 10).cast("bigint") % n + 1
    return every.select("tree", picked.alias("place")).groupBy("tree", "place").agg(F.count(F.lit(1)).alias("weight"))


_NODES = {"path": pa.int64(), "feature": pa.int32(), "threshold": pa.float64(), "left": pa.int32(), "right": pa.int32(), "weight": pa.float64(),
          "value": pa.float64(), "gain": pa.float64()}
_NODES_SQL = "tree bigint, path array<bigint>, feature array<int>, threshold array<double>, `left` array<int>, `right` array<int>, " \
             "weight array<double>, value array<double>, gain array<double>"


def _drawn_rows(folder: str, n_inputs: int):
    """A task's function: from the training rows in a folder (``position, xs, y``) those at sorted ``positions``, as matrix and
    targets. A file is read piece by piece and only rows that were drawn are kept."""
    store, base = store_of(folder)

    def read(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.empty((len(positions), n_inputs)), np.empty(len(positions))
        for file in sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")):
            with store.open_input_file(file) as source:
                for batch in pq.ParquetFile(source).iter_batches(BLOCK_ROWS):
                    at = batch.column(0).to_numpy()
                    to = np.searchsorted(positions, at)
                    own = np.flatnonzero(positions[np.minimum(to, len(positions) - 1)] == at)
                    x[to[own]] = _matrix(batch, "xs")[own]
                    y[to[own]] = batch.column(2).to_numpy()[own]
        return x, y

    return read


def fit_forest(train: DataFrame, names: list[str], target: str, spec: ForestSpec) -> Forest:
    """A forest on rows with the ``position`` of ``split`` (without gaps, whatever the first). Each tree is grown by one task from all rows
    that it drew, which the task reads from the shared folder; trees are spread over all tasks and kept as a table.

    No training row is shuffled. A task holds the distinct rows of one bootstrap (some 63 % of the training rows) with the order of each
    input, 12 bytes a value.
    """
    xs = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    y = F.round(F.col(target).cast("double") / UNIT)
    folder = scratch_path(train.sparkSession, "train")
    train.select(F.col("position").cast("bigint").alias("position"), xs.alias("xs"), y.alias("y")).write.parquet(folder)
    first, n = train.sparkSession.read.parquet(folder).agg(F.min("position"), F.count(F.lit(1))).first()
    depth, bins, unit, before, drawn = spec.depth, spec.bins, UNIT, (first or 1) - 1, _drawn_rows(folder, len(names))
    schema = pa.schema([("tree", pa.int64()), *((name, pa.list_(kind)) for name, kind in _NODES.items())])

    def fit(table: pa.Table) -> pa.Table:
        place, weight = (table[c].to_numpy() for c in ("place", "weight"))
        order = np.argsort(place)
        x, y = drawn(place[order] + before)
        tree = grow(x, y, weight[order].astype(float), depth, bins)
        tree["value"] = tree["total"] / tree["weight"] * unit
        return pa.table([table["tree"].combine_chunks()[:1], *(pa.array([tree[name]], pa.list_(kind)) for name, kind in _NODES.items())], schema=schema)

    # As many partitions as trees: the work lies in the fit, so sizes in bytes must not decide how many tasks share it.
    trees = pin(draws(spec, F.lit(n)).groupBy("tree").applyInArrow(fit, _NODES_SQL))
    shards, held, files = [], 0, {}
    for tree, size, file in trees.select("tree", F.size("path"), "_metadata.file_path").orderBy("tree").collect():
        files[tree] = file
        if shards and held + size <= SHARD_NODES:
            shards[-1], held = (shards[-1][0], tree), held + size
        else:
            shards, held = [*shards, (tree, tree)], size
    return Forest(trees, shards, spec.trees, files)


def _trees_of(model: Forest):
    """A task's function: shard after shard of the forest from the shared folder, each a list of trees for ``predict_sum``. Neither
    the driver nor a task holds the forest."""
    shards, files, columns = model.shards, model.files, ["feature", "threshold", "left", "right", "value"]

    def read(tree: int) -> tuple:
        store, place = store_of(files[tree])
        row = pq.read_table(place, filesystem=store, columns=["tree", *columns], partitioning=None).combine_chunks()
        at = row["tree"].to_pylist().index(tree)
        return tuple(row[c][at].values.to_numpy() for c in columns)

    return lambda: ([read(t) for t in range(low, high + 1) if t in files] for low, high in shards)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``BLOCK_ROWS`` rows, but for the last."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _spread(df: DataFrame) -> DataFrame:
    """Predictions cost by rows and trees, not by bytes: twice as many partitions as cores, however few bytes the rows have."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def predict(model: Forest, df: DataFrame, values: str = "xs") -> DataFrame:
    """Adds ``prediction``, the mean over the trees, in one pass; each task takes its rows past the shards of the forest."""
    schema, shards, n_trees = df.drop("prediction").schema.add("prediction", "double"), _trees_of(model), model.n_trees
    kept = [c for c in df.columns if c != "prediction"]

    def add(batches):
        for batch in _blocks(batches):
            x, total = _matrix(batch, values), np.zeros(batch.num_rows)
            for trees in shards():
                total += predict_sum(x, trees)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total / n_trees)], [*kept, "prediction"])

    return _spread(df.select(*kept)).mapInArrow(add, schema)


def with_values(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """``rid, y, xs`` of the test rows."""
    xs = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    return df.where("is_test").select(F.col("position").alias("rid"), F.col(target).cast("double").alias("y"),
                                      xs.alias("xs"))


def impurity_importance(df: DataFrame, model: Forest, names: list[str]) -> DataFrame:
    """Mean over the trees of each feature's share of the tree's gain; a tree without a split has none."""
    cells = model.trees.select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("n")).where("n.feature >= 0")
    each = cells.groupBy("tree", F.col("n.feature").alias("f")).agg(F.sum("n.gain").alias("gain"))
    whole = each.groupBy("tree").agg(F.sum("gain").alias("whole"))
    shares = each.join(whole, "tree").groupBy("f").agg(F.sum(F.try_divide("gain", "whole")).alias("share"))
    total = shares.agg(F.sum("share").alias("all"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "f int, feature string")
    return listed.join(shares, "f", "left").select("feature", F.coalesce(F.try_divide(F.col("share"), total.scalar()), F.lit(0.0)).alias("impurity_importance"))


def permutations(test: DataFrame, repeats: int, seed: int) -> DataFrame:
    """``repeat, rid, donor`` beside the other columns: per repeat a keyed permutation of 1..n, computed row by row."""
    n = test.agg(F.count(F.lit(1))).scalar()
    width = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what follows costs by rows, not by bytes
    rows = test.repartition(width, "rid").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("_n", n)
    return rows.withColumn("donor", keyed_permutation(F.col("rid"), F.col("_n"), seed, F.col("repeat"))).drop("_n")


def permutation_importance(model: Forest, test: DataFrame, names: list[str],
                           spec: ForestSpec) -> DataFrame:
    """Mean drop of R2 on the test rows when one feature is shuffled.

    Within a repeat all features share the permutation, so the donor's values are joined once per repeat rather
    than once per feature, and one walk down the trees gives the predictions of a row under all its swaps.
    """
    donors = test.select(F.col("rid").alias("donor"), F.col("xs").alias("donor_xs"))
    pairs = permutations(test, spec.repeats, spec.seed).join(donors, "donor").select("repeat", "y", "xs", "donor_xs")
    shards, n_trees = _trees_of(model), model.n_trees

    def swap(batches):
        for batch in _blocks(batches):
            x, z = _matrix(batch, "xs"), _matrix(batch, "donor_xs")
            total = np.zeros(x.shape)
            for trees in shards():
                total += predict_swapped_sum(x, z, trees)[1]
            flat = pa.array((total / n_trees).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                np.arange(0, total.size + 1, x.shape[1], dtype=np.int32), flat)], ["repeat", "y", "predictions"])

    predicted = _spread(pairs).mapInArrow(swap, "repeat int, y double, predictions array<double>") \
        .select("repeat", "y", F.posexplode("predictions").alias("f", "prediction"))
    shuffled = summaries.regression_scores(predicted, "y", "prediction", by=["f", "repeat"])
    base = summaries.regression_scores(predict(model, test), "y", "prediction").select("r2").scalar()
    label = F.element_at(F.array(*map(F.lit, names)), F.col("f") + 1)
    return shuffled.groupBy(label.alias("feature")).agg(F.avg("r2").alias("_r2")) \
        .select("feature", (base - F.col("_r2")).alias("permutation_importance"))


def rank_importance(df: DataFrame, names: list[str], key: list[str], target: str,
                    spec: ForestSpec = ForestSpec()) -> tuple[DataFrame, DataFrame]:
    """Importance table of one target (sorted) and its scores on the test rows."""
    parts = pin(split(df.select(*key, *[F.col(f"`{n}`") for n in names], F.col(target).alias("_target")), key,
                      spec.seed, spec.test_share))
    model = fit_forest(parts.where(~F.col("is_test")), names, "_target", spec)
    test = with_values(parts, names, "_target")
    both = impurity_importance(df, model, names).join(
        permutation_importance(model, test, names, spec), "feature", "full")
    scores = summaries.regression_scores(predict(model, test), "y", "prediction")
    table = both.select(F.lit(target).alias("target"), "feature", "impurity_importance", "permutation_importance") \
        .orderBy(F.desc("permutation_importance"), "feature")
    return table, scores.select(F.lit(target).alias("target"), "r2", "mae")


def feature_rank(importance: DataFrame, value: str, rank: str) -> DataFrame:
    """Average rank, largest first. The table has one row per feature, so one task holds it."""
    everyone = Window.orderBy(F.desc(value))
    same = F.count(F.lit(1)).over(Window.partitionBy(value))
    return importance.select("feature", (F.rank().over(everyone) + (same - 1) / 2).alias(rank))


def compare_targets(first: DataFrame, second: DataFrame, value: str = "permutation_importance") -> DataFrame:
    """Ranks under two targets and their shift (second minus first)."""
    a = feature_rank(first, value, "pain_rating_rank")
    b = feature_rank(second, value, "stimulus_rank")
    return a.join(b, "feature", "full").withColumn("rank_shift", F.col("stimulus_rank") - F.col("pain_rating_rank")) \
        .orderBy("pain_rating_rank", "feature")


def side_by_side(first: DataFrame, second: DataFrame, value: str = "permutation_importance") -> DataFrame:
    """The second target's importance in the order of the first; features it lacks are NULL."""
    return first.select("feature", F.col(value).alias("x")).join(
        second.select("feature", F.col(value).alias("y")), "feature", "left")


def axis_limit(points: DataFrame, margin: float = 1.1) -> DataFrame:
    return points.agg((F.greatest(F.max("x"), F.max("y")) * margin).alias("lim"))


def top(importance: DataFrame, n: int = 10, value: str = "permutation_importance") -> DataFrame:
    """The n largest, in ascending order for display."""
    return importance.orderBy(F.desc(value), "feature").limit(n).orderBy(F.asc(value), F.desc("feature"))
