"""Summaries, ranks and the model steps, with hot values and hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evoq.config import SignalSpec
from evoq.operators import complexity, erp, ranking, summaries, trials
from evoq.plans import importance as imp
from evoq.plans import reports

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value a third of them; one group is a single row, one has no value."""
    hot = [("hot", float(v)) for v in RNG.normal(size=4000)] + [("hot", 0.25)] * 2000
    cold = [("cold", float(v)) for v in RNG.exponential(size=37)]
    return spark.createDataFrame(hot + cold + [("one", 3.0), ("none", None)], "g string, v double").repartition(8)


@pytest.fixture(scope="module")
def values(skewed):
    out = {}
    for g, v in skewed.collect():
        out.setdefault(g, []).append(v)
    return {g: np.array([x for x in v if x is not None]) for g, v in out.items()}


def test_exact_quantiles(skewed, values):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in ranking.exact_quantiles(skewed, ["g"], "v", shares).collect()}
    assert len(got) == 3 * len(shares)
    for g in ("hot", "cold", "one"):
        for s in shares:
            assert got[g, s] == pytest.approx(np.quantile(values[g], s), rel=1e-12)
    whole = ranking.exact_quantiles(skewed, [], "v", [0.5]).collect()
    assert whole[0]["quantile"] == pytest.approx(np.median(np.concatenate(list(values.values()))), rel=1e-12)


def test_average_rank(skewed, values):
    got = {(r["g"], r["v"]): r["rank"] for r in ranking.average_rank(skewed, "v", ["g"], descending=False).collect()}
    for g, v in values.items():
        for x in np.unique(v):
            assert got[g, x] == (v < x).sum() + ((v == x).sum() + 1) / 2


def test_digest_positions_are_whole_and_repeatable(spark):
    rows = spark.range(20000).withColumn("d", ranking.shuffle_digest(1, F.col("id")))
    a = ranking.digest_position(rows, "d").select("id", "position").collect()
    assert sorted(r["position"] for r in a) == list(range(1, 20001))
    b = ranking.digest_position(rows.repartition(3), "d").select("id", "position").collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


def test_histograms(skewed, values):
    rows = summaries.equal_width_histogram(skewed, "g", "v", 15).orderBy("bin").collect()
    for g in ("hot", "cold", "one"):
        n, edges = np.histogram(values[g], bins=15)
        assert [r["n"] for r in rows if r["g"] == g] == n.tolist()
        assert [r["low"] for r in rows if r["g"] == g] == pytest.approx(edges[:-1].tolist())
        density = np.histogram(values[g], bins=15, density=True)[0]
        assert [r["density"] for r in rows if r["g"] == g] == pytest.approx(density.tolist())
    assert not [r for r in rows if r["g"] == "none"]


def test_histogram_edges_of_decimal_values(spark):
    vals = [i / 10 for i in range(0, 51)]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    got = [r["n"] for r in summaries.equal_width_histogram(df, "g", "v", 20).orderBy("bin").collect()]
    assert got == np.histogram(vals, bins=20)[0].tolist()
    whole = [r["n"] for r in summaries.unit_histogram(spark.createDataFrame([("g", float(v)) for v in (-1, 0, 3.5, 10, 11, 12)], "g string, v double"), "g", "v").orderBy("bin").collect()]
    assert whole == np.histogram([0, 3.5, 10, 11], bins=range(0, 12))[0].tolist()


def test_box_stats(skewed, values):
    got = {r["g"]: r for r in summaries.box_stats(skewed, "g", "v").collect()}
    for g in ("hot", "cold"):
        v = values[g]
        q1, q3 = np.quantile(v, [0.25, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (got[g]["whisker_low"], got[g]["whisker_high"], got[g]["n_outliers"]) == (inside.min(), inside.max(), len(v) - len(inside))


def test_describe_keeps_an_all_missing_group(skewed):
    got = {r["g"]: r for r in summaries.describe(skewed, ["g"], "v", full=True).collect()}
    assert got["none"]["count"] == 0 and got["none"]["mean"] is None and got["none"]["q50"] is None
    assert got["one"]["std"] is None and got["one"]["q25"] == 3.0


def test_correlation_without_variance(spark):
    rows = [("a", 1.0, float(i)) for i in range(5)] + [("b", float(i), 2.0 * i) for i in range(5)] + [("c", 1.0, 2.0)]
    got = {r["g"]: r["r"] for r in summaries.pearson(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1) and "c" not in got


def test_zero_rating_report_without_zeros(spark):
    labels = spark.createDataFrame([("d", "s", 0, 5.0, 3.5)], "dataset string, subject string, epoch int, rating double, laser_power double")
    rows = {(r["section"], r["metric"]): r["value"] for r in reports.as_long(reports.zero_ratings(labels)).collect()}
    assert rows["totals", "n_zero"] == 0 and rows["totals", "zero_pct"] == 0 and rows["per_subject", "n_groups"] == 0


@pytest.fixture(scope="module")
def model_rows(spark):
    x = RNG.normal(size=(400, 3))
    rows = [("d", i, float(a), float(b), float(c), float(5 * a + 0.1 * b), float(b)) for i, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(rows, "dataset string, epoch int, `a-b` double, f2 double, f3 double, rating double, laser_power double")


def test_split_is_exact(model_rows):
    parts = imp.split(model_rows, ["epoch"]).collect()
    assert sum(r["is_test"] for r in parts) == 80
    assert sorted(r["position"] for r in parts if r["is_test"]) == list(range(1, 81))


def test_permutations(spark):
    test = spark.range(1, 101).withColumnRenamed("id", "rid")
    rows = imp.permutations(test, 3, 42).collect()
    for repeat in (1, 2, 3):
        own = {r["rid"]: r["donor"] for r in rows if r["repeat"] == repeat}
        assert sorted(own) == sorted(own.values()) == list(range(1, 101))
        assert own != {i: i for i in own}


def test_ranking_finds_the_feature(model_rows):
    spec = imp.ForestSpec(trees=20, depth=6, bins=32, repeats=5)
    names = imp.feature_names(model_rows.columns)
    assert names == ["a-b", "f2", "f3"]
    table, scores = imp.rank_importance(model_rows, names, ["epoch"], "rating", spec)
    rows = table.collect()
    assert rows[0]["feature"] == "a-b" and rows[0]["permutation_importance"] > 1
    assert sum(r["impurity_importance"] for r in rows) == pytest.approx(1)
    assert scores.first()["r2"] > 0.8
    other, _ = imp.rank_importance(model_rows, names, ["epoch"], "laser_power", spec)
    shift = {r["feature"]: r["rank_shift"] for r in imp.compare_targets(table, other).collect()}
    assert shift["a-b"] > 0 and shift["f2"] < 0


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0)], "feature string, v double")
    assert {r["feature"]: r["r"] for r in imp.feature_rank(df, "v", "r").collect()} == {"a": 1.5, "c": 1.5, "b": 3.0}


def test_features_without_a_value_are_no_inputs(spark):
    rows = spark.createDataFrame([(i, 1.0 * i, None, 2.0, 3.0) for i in range(4)], "epoch int, a double, `plv_C3-C4` double, rating double, laser_power double")
    filled, names = imp.model_inputs(rows)
    assert names == ["a"] and "plv_C3-C4" not in filled.columns and filled.count() == 4


def test_crosstab_counts_values_beyond_the_list(spark):
    rows = spark.createDataFrame([("d", "F"), ("d", "M"), ("d", "X"), ("e", "X"), ("e", None)], "dataset string, sex string")
    got = {r["dataset"]: (r["F"], r["M"], r["other"]) for r in summaries.crosstab(rows, "dataset", "sex", ["F", "M"]).collect()}
    assert got == {"d": (1, 1, 1), "e": (0, 0, 1)}


def test_first_event_is_one_event(spark):
    rows = spark.createDataFrame([("d", "s", 1, 0, None, 7.0), ("d", "s", 1, 0, 2.0, 1.0), ("d", "s", 1, 1, 9.0, 9.0)],
                                 "dataset string, subject string, epoch int, event_pos int, rating double, laser_power double")
    assert [tuple(r) for r in trials.first_event_per_epoch(rows).collect()] == [("d", "s", 0, None, 7.0)]


def test_baseline_without_numbers_gives_no_peaks(spark):
    spec = SignalSpec(windows={"baseline": (-0.2, -0.1), "n2": (0.0, 0.1), "p2": (0.2, 0.3)})
    nan = float("nan")
    df = spark.createDataFrame([(-0.2, 10.0, [nan, nan, 1.0, 5.0, 2.0, 3.0]), (0.0, 10.0, [5.0, 4.0, 3.0, 2.0])], "t0 double, sfreq double, signal array<double>")
    df = df.withColumn("n_times", F.size("signal"))
    got = [(r["n2_amp"], r["p2_amp"]) for r in erp.with_peaks(df, spec).collect()]
    assert got == [(None, None), (4.0, 3.0)]


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from evoq.session import shared_folder
    fake = lambda master, folder: SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_folder(fake("yarn", "hdfs:///x/")) == "hdfs:///x"
    assert shared_folder(fake("local[2]", None))
    with pytest.raises(RuntimeError):
        shared_folder(fake("local-cluster[1,1,1024]", None))


@pytest.mark.parametrize("inside", [1, 5, 10**6])
def test_quantiles_of_narrowed_ranges(spark, monkeypatch, inside):
    """Ranges are cut until few rows are inside; equal values, several groups, extremes and infinite values included."""
    from evoq.operators import ranking
    monkeypatch.setattr(ranking, "INSIDE", inside)
    monkeypatch.setattr(ranking, "BINS", 8)
    values = {"a": RNG.normal(size=700), "b": np.round(RNG.normal(size=501), 1), "c": np.full(40, 3.5), "d": np.array([1e300, -1e300, 2.0, 5.0]),
              "e": np.array([7.0]), "f": np.array([np.inf, 1.0, 2.0, 3.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    df = spark.createDataFrame(rows + [("a", None)], "g string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "v", shares).collect()}
    assert len(got) == 30
    for k, v in values.items():
        for s in shares:
            want = np.quantile(v[np.isfinite(v)], s) if k != "f" else {0.0: 1.0, 0.25: 1.75, 0.5: 2.5, 1.0: np.inf}.get(s)
            assert want is None or got[k, s] == pytest.approx(want, rel=1e-12), (k, s)
    alone = ranking.exact_quantiles(df.where("g = 'a'"), [], "v", [0.5]).collect()
    assert [r["quantile"] for r in alone] == [pytest.approx(np.median(values["a"]))]


def test_ranks_and_places_in_many_ranges(spark):
    """Far more ranges than the rows of one hold, with a value that a third of the rows have."""
    pick = np.random.default_rng(8)
    values = [float(v) for v in np.where(pick.random(6000) < .33, 7.0, pick.integers(0, 3000, 6000))]
    df = spark.createDataFrame([("g" if i % 2 else None, v) for i, v in enumerate(values)], "g string, v double").repartition(5)
    got = {(r.g, r.v): r["rank"] for r in ranking.average_rank(df.where("g is not null"), "v", ["g"], per_range=50).collect()}
    own = pd.Series(values[1::2])
    assert got == {("g", v): r for v, r in zip(own, own.rank(ascending=False))}
    alone = {r.v: r["rank"] for r in ranking.average_rank(df, "v", per_range=7, descending=False).collect()}
    assert alone == dict(zip(values, pd.Series(values).rank()))
    assert ranking.average_rank(df.limit(0), "v").count() == 0


def test_range_join_counts_templates(spark):
    from evoq.functions.kernels import template_matches
    pick = np.random.default_rng(2)
    signals = [pick.normal(size=300), np.zeros(300), np.repeat([0.0, 1.0, 5.0], 100), np.arange(300.0), np.round(pick.normal(size=300), 1) + 1000]
    df = spark.createDataFrame([("d", "s", k, 1000.0, 0.0, 300, [float(v) for v in x]) for k, x in enumerate(signals)],
                               "dataset string, subject string, epoch int, sfreq double, t0 double, n_times int, signal array<double>")
    spec = SignalSpec(windows={**SignalSpec().windows, "psd": (0.0, 10.0)})
    got = {r.epoch: (r.short, r.long) for r in complexity.template_pairs(df, spec).collect()}
    assert got == {k: tuple(int(n[0]) for n in template_matches(x[None], spec.entropy_tolerance)) for k, x in enumerate(signals)}
