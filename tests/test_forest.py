import numpy as np
import pytest
from pyspark.sql import functions as F

from evoq.functions.trees import grow, predict_sum, predict_swapped_sum
from evoq.operators.ranking import keyed_permutation
from evoq.plans import importance as imp

RNG = np.random.default_rng(17)


def plain_tree(x, y, w, depth):
    """Nodes by recursion over all cuts: path -> (feature, threshold) or the leaf's mean."""
    out = {}

    def split(rows, path, level):
        s, n = (w[rows] * y[rows]).sum(), w[rows].sum()
        best = None
        if level < depth and y[rows].min() < y[rows].max():
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for a, b in zip(values[:-1], values[1:]):
                    low = rows[x[rows, f] <= a]
                    sl, wl = (w[low] * y[low]).sum(), w[low].sum()
                    gain = sl * sl / wl + (s - sl) * (s - sl) / (n - wl)
                    if best is None or gain > best[0]:
                        best = gain, f, (a + b) / 2
        out[path] = (s / n,) if best is None else best[1:]
        if best is not None:
            split(rows[x[rows, best[1]] <= best[2]], 2 * path, level + 1)
            split(rows[x[rows, best[1]] > best[2]], 2 * path + 1, level + 1)

    split(np.arange(len(y)), 1, 0)
    return out


@pytest.mark.parametrize("depth", [0, 1, 4, 60])
def test_tree_equals_recursion(depth):
    x = np.round(RNG.normal(size=(70, 4)), 1)  # many equal values
    y, w = np.round(RNG.normal(size=70) * 8), RNG.integers(1, 4, 70).astype(float)
    tree = grow(x, y, w, depth)
    want = plain_tree(x, y, w, depth)
    assert {int(p): (int(f), t) if f >= 0 else (s / n,) for p, f, t, s, n in zip(
        tree["path"], tree["feature"], tree["threshold"], tree["total"], tree["weight"])} == want
    shuffled = RNG.permutation(70)
    assert all((tree[k] == v).all() for k, v in grow(x[shuffled], y[shuffled], w[shuffled], depth).items())


def test_tree_of_few_values_and_of_one_row():
    x, y = np.arange(1000.0)[:, None], np.arange(1000.0)
    assert len(np.unique(grow(x, y, np.ones(1000), 60, bins=8)["threshold"])) <= 9
    one = grow(np.zeros((1, 2)), np.array([5.0]), np.ones(1), 60)
    assert one["feature"].tolist() == [-1]
    assert predict_sum(np.full((3, 2), np.nan), [(one["feature"], one["threshold"], one["left"], one["right"], one["total"])]).tolist() == [5, 5, 5]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_keyed_permutation_is_one(spark, n):
    rows = spark.range(1, n + 1).select("id", *[keyed_permutation(F.col("id"), F.lit(n), 42, F.lit(k)).alias(f"p{k}") for k in range(3)]).collect()
    for k in range(3):
        assert sorted(r[f"p{k}"] for r in rows) == list(range(1, n + 1))
    if n == 1000:
        moved = np.array([[r.id, r.p0, r.p1] for r in rows])
        assert np.abs(np.corrcoef(moved.T)[np.triu_indices(3, 1)]).max() < 0.15 and (moved[:, 0] == moved[:, 1]).sum() < 10


@pytest.fixture(scope="module")
def parts(spark):
    x = RNG.normal(size=(120, 3))
    rows = [(i + 1, *map(float, a), float(3 * a[0] + a[1]), i < 24) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "position bigint, a double, b double, c double, y double, is_test boolean")


def trees_of(model):
    return model.trees.orderBy("tree").collect()


def test_forest_does_not_depend_on_partitions(spark, parts, monkeypatch):
    spec, names = imp.ForestSpec(trees=12), ["a", "b", "c"]
    train = parts.where("not is_test")
    model = imp.fit_forest(train.repartition(7), names, "y", spec)
    assert trees_of(model) == trees_of(imp.fit_forest(train.coalesce(1), names, "y", spec))
    assert all(sum(w for w, f in zip(t.weight, t.feature) if f < 0) == 96 for t in trees_of(model))
    test = imp.with_values(parts, names, "y")
    whole = {r.rid: r.prediction for r in imp.predict(model, test).collect()}
    monkeypatch.setattr(imp, "SHARD_NODES", 200)
    sharded = imp.fit_forest(train, names, "y", spec)
    assert len(sharded.shards) > 3 and sharded.shards[0][0] == 1 and sharded.shards[-1][1] == 12
    again = {r.rid: r.prediction for r in imp.predict(sharded, test.withColumn("prediction", F.lit("clash"))).collect()}
    assert whole.keys() == again.keys() and all(whole[i] == pytest.approx(again[i]) for i in whole)
    r2 = imp.summaries.regression_scores(imp.predict(model, test), "y", "prediction").first()["r2"]
    assert r2 > 0.7


def test_a_tree_takes_a_bounded_number_of_rows(spark, parts):
    model = imp.fit_forest(parts.where("not is_test"), ["a"], "y", imp.ForestSpec(trees=5, rows_per_tree=10))
    assert [t.weight[0] for t in trees_of(model)] == [10.0] * 5


def test_permutations_are_made_without_a_window(spark, parts):
    test = imp.with_values(parts, ["a", "b", "c"], "y")
    plan = imp.permutations(test, 15, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_swapped_predictions_equal_a_walk_per_feature():
    x, y = np.round(RNG.normal(size=(300, 5)), 1), np.round(RNG.normal(size=300) * 8)
    tree = grow(x, y, np.ones(300), 60)
    forest = [(tree["feature"], tree["threshold"], tree["left"], tree["right"], tree["total"] / tree["weight"])] * 2
    a, b = RNG.normal(size=(50, 5)), RNG.normal(size=(50, 5))
    a[0], b[1] = np.nan, np.nan
    own, swapped = predict_swapped_sum(a, b, forest, block=16)
    assert own.tolist() == predict_sum(a, forest).tolist()
    for f in range(5):
        one = a.copy()
        one[:, f] = b[:, f]
        assert swapped[:, f].tolist() == predict_sum(one, forest).tolist()


def test_draws_and_trees_do_not_pass_the_driver(spark, parts, monkeypatch):
    plans, pin = [], imp.pin

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return pin(df)

    monkeypatch.setattr(imp, "pin", seen)
    spec, names = imp.ForestSpec(trees=4), ["a", "b", "c"]
    model = imp.fit_forest(parts.where("not is_test"), names, "y", spec)
    assert not any("Broadcast" in p for p in plans)
    test = imp.with_values(parts, names, "y")
    monkeypatch.setattr(type(test), "toArrow", None)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    assert len(plans) == 1 and imp.predict(model, test).count() == 24 and len(plans) == 1
    assert imp.permutation_importance(model, test, names, spec).count() == 3


def test_a_tree_is_fitted_on_a_bootstrap_of_all_rows(spark):
    n = 50_500
    train = spark.range(11, 11 + n).select(F.col("id").alias("position"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).alias("y"))
    model = imp.fit_forest(train, ["a"], "y", imp.ForestSpec(trees=2))
    assert [t.weight[0] for t in trees_of(model)] == [n] * 2
    from testbed import registry
    import testbed.model_queries  # noqa: F401
    assert "least(n" not in registry.SQL["M5_permutation_importance"]


def test_draws_are_not_shuffled_and_meet_their_rows(spark):
    spec = imp.ForestSpec(trees=3)
    counted = imp.draws(spec, F.lit(500))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(tree" in plan
    train = spark.range(1, 501).select(F.col("id").alias("position"), (F.col("id") * 1.0).alias("a"), (F.col("id") * 2).alias("y"))
    want = {}
    for r in counted.collect():
        at = want.setdefault(r.tree, [0, 0])
        want[r.tree] = [at[0] + r.weight, at[1] + r.weight * r.place * 2]
    for t in trees_of(imp.fit_forest(train.repartition(5), ["a"], "y", spec)):
        assert [t.weight[0], round(t.value[0] * t.weight[0])] == want[t.tree] and want[t.tree][0] == 500
