"""Queries on the model table: split, forest, importances, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from evoq.operators import summaries
from evoq.operators.ranking import digest_position, shuffle_digest
from evoq.plans import importance as imp
from testbed import inputs as I
from testbed.registry import query, rnd, rounded

MX = I.MATRIX_SQL
# The forest of M5 is fitted on whole bootstraps; the SQL of the other queries bounds the draws of a tree.
SPEC, WHOLE = imp.ForestSpec(rows_per_tree=50_000), imp.ForestSpec()
FITTED: dict = {}
CHOSEN = "mc AS (SELECT * FROM mx WHERE rating IS NOT NULL AND laser_power IS NOT NULL)"
PLACE = "pl AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || epoch)) AS position, count(*) OVER () AS total FROM mc)"


def correlations(spark, sf, target):
    """Absolute correlation of each feature with a target: a cheap importance that SQL can repeat."""
    long = summaries.to_long(I.matrix(spark, sf), ["rating", "laser_power"], I.FEATURES)
    return summaries.pearson(long, "feature", "value", target).select("feature", F.round(F.abs("r"), 9).alias("value"))


def correlation_sql(name, target):
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {rnd(f'abs(corr({f}, {target}))')} AS value FROM mx" for f in I.FEATURES) + ")"


CR, CP = correlation_sql("cr", "rating"), correlation_sql("cp", "laser_power")
RANK = "rank() OVER (ORDER BY value DESC) + (count(*) OVER (PARTITION BY value) - 1) / 2"
RANKED = f"""ra AS (SELECT feature, {RANK} AS r FROM cr), rb AS (SELECT feature, {RANK} AS r FROM cp)"""


@query("M1_train_test_split", "SELECT epoch, position, position <= ceil(total * 0.2) AS is_test FROM pl", (MX, CHOSEN, PLACE))
def m1(spark, sf):
    rows = imp.labelled(I.matrix(spark, sf))
    return imp.split(rows, ["epoch"]).select("epoch", "position", "is_test")


@query("M8_median_imputation", "SELECT epoch, " + ", ".join(f"{rnd(f'coalesce({f}, (SELECT median({f}) FROM mc))')} AS {f}" for f in I.FEATURES) + " FROM mc", (MX, CHOSEN))
def m8(spark, sf):
    filled, names = imp.model_inputs(I.matrix(spark, sf))
    return rounded(filled.select("epoch", *names))


@query("F12_fill_with_median", "SELECT epoch, " + ", ".join(f"{rnd(f'coalesce({f}, (SELECT median({f}) FROM mx))')} AS {f}" for f in I.FEATURES) + " FROM mx", (MX,))
def f12(spark, sf):
    return rounded(summaries.impute_medians(I.matrix(spark, sf).select("epoch", *I.FEATURES), I.FEATURES))


UNIT = repr(imp.UNIT) + "::DOUBLE"
MEDIANS = "md AS (SELECT " + ", ".join(f"median({f}) AS m_{f}" for f in I.FEATURES) + " FROM mc)"


def forest_sql(target, end="", spec=SPEC):
    """The whole forest of a target, level by level: bootstraps, splits, nodes (``nd``) and inner nodes (``inn``). ``end`` is put behind
    the names of the tables, where a query needs two."""
    size = "n" if spec.rows_per_tree is None else f"least(n, {spec.rows_per_tree})"
    return f"""fl{end} AS (SELECT position, position <= ceil(total * 0.2) AS is_test, {target} AS target, round({target} / {UNIT}) AS y,
    [{', '.join(f'coalesce({f}, m_{f})' for f in I.FEATURES)}] AS xs FROM pl, md),
tr{end} AS (SELECT position, y, xs, min(position) OVER () - 1 AS before, count(*) OVER () AS n FROM fl{end} WHERE NOT is_test),
bag{end} AS (SELECT tree, before + 1 + ('0x' || substr(md5('42|' || tree || '|' || draw), 1, 12))::BIGINT % n AS position, count(*)::DOUBLE AS w
    FROM range(1, {SPEC.trees} + 1) t(tree), (SELECT DISTINCT n, before FROM tr{end}), range(1, {size} + 1) d(draw) GROUP BY 1, 2),
lf{end} AS (SELECT position, unnest(range(0, {len(I.FEATURES)})) AS f, unnest(xs) AS v FROM tr{end}),
gr{end}(tree, node, level, position, w, y, f, cut, gain) AS (
    SELECT tree, 1::BIGINT, 0, position, w, y, -1::BIGINT, 0::DOUBLE, 0::DOUBLE FROM bag{end} JOIN tr{end} USING (position)
    UNION ALL SELECT * FROM (
    WITH impure AS (SELECT tree, node, sum(w) AS nw, sum(w * y) AS ns FROM gr{end} GROUP BY 1, 2 HAVING min(y) <> max(y)),
    c AS (SELECT g.tree, g.node, lf.f, lf.v, sum(g.w) AS vw, sum(g.w * g.y) AS vs FROM gr{end} g SEMI JOIN impure i ON i.tree = g.tree AND i.node = g.node
        JOIN lf{end} lf ON lf.position = g.position GROUP BY ALL),
    s AS (SELECT tree, node, f, v, sum(vw) OVER x AS wl, sum(vs) OVER x AS sl, lead(v) OVER x AS nv FROM c WINDOW x AS (PARTITION BY tree, node, f ORDER BY v)),
    q AS (SELECT s.tree, s.node, f, v, nv, sl * sl / wl + (ns - sl) * (ns - sl) / (nw - wl) AS g, ns * ns / nw AS own
        FROM s JOIN impure i ON i.tree = s.tree AND i.node = s.node WHERE nv IS NOT NULL),
    b AS (SELECT tree, node, arg_max((f, CASE WHEN (v + nv) / 2 < nv THEN (v + nv) / 2 ELSE v END, g - own), (g, -f, -v)) AS best FROM q GROUP BY 1, 2)
    SELECT g.tree, 2 * g.node + (tr.xs[best[1] + 1] > best[2])::BIGINT, g.level + 1, g.position, g.w, g.y, best[1], best[2], best[3]
    FROM gr{end} g JOIN b ON b.tree = g.tree AND b.node = g.node JOIN tr{end} tr ON tr.position = g.position WHERE g.level < {SPEC.depth})),
nd{end} AS (SELECT tree, node, any_value(f) AS f, any_value(cut) AS cut, any_value(gain) AS gain, sum(w * y) / sum(w) * {UNIT} AS value FROM gr{end} GROUP BY 1, 2),
inn{end} AS (SELECT tree, node // 2 AS node, f, cut, gain FROM nd{end} WHERE node > 1 AND node % 2 = 0)"""


def predictions_sql(rows, name, end=""):
    """Means over the trees for ``rows`` (``id, xs``): every row walks down every tree."""
    return f"""{name}w(id, xs, tree, node, f, cut) AS (SELECT id, xs, i.tree, 1::BIGINT, i.f, i.cut FROM {rows}, inn{end} i WHERE i.node = 1
    UNION ALL SELECT w.id, w.xs, w.tree, c.node, i.f, i.cut FROM {name}w w
    JOIN nd{end} c ON c.tree = w.tree AND c.node = 2 * w.node + (w.xs[w.f + 1] > w.cut)::BIGINT
    LEFT JOIN inn{end} i ON i.tree = c.tree AND i.node = c.node WHERE w.f IS NOT NULL),
{name} AS (SELECT id, sum(nd.value) / {SPEC.trees} + (SELECT coalesce(sum(value), 0) FROM nd{end} r WHERE node = 1
        AND NOT EXISTS (SELECT 1 FROM inn{end} i WHERE i.tree = r.tree)) / {SPEC.trees} AS prediction
    FROM {name}w w JOIN nd{end} nd ON nd.tree = w.tree AND nd.node = w.node WHERE w.f IS NULL GROUP BY id)"""


def stirred(half, key):
    square = lambda v: f"(({v}) % 2147483647) * (({v}) % 2147483647) % 2147483647"
    return square(f"({square(f'{half} + {key}')}) * 48271 + {key}")


def walked(x, keys):
    return f"list_reduce(list_concat([{x}], {keys}), lambda h, k: (h % side) * side + (h // side + {stirred('(h % side)', 'k')}) % side)"


DONORS = f"""te AS (SELECT position AS rid FROM pl WHERE position <= ceil(total * 0.2)),
dk AS (SELECT repeat::INT AS repeat, n, ceil(sqrt(n))::BIGINT AS side, [{', '.join(f"('0x' || substr(md5('42|' || repeat || '|{i}'), 1, 7))::BIGINT" for i in range(4))}] AS keys
    FROM range(1, {SPEC.repeats} + 1) r(repeat), (SELECT count(*) AS n FROM te)),
dn(repeat, rid, x, n, side, keys) AS (SELECT repeat, rid, {walked('rid - 1', 'keys')}, n, side, keys FROM te, dk
    UNION ALL SELECT repeat, rid, {walked('x', 'keys')}, n, side, keys FROM dn WHERE x >= n),
pm AS (SELECT repeat, rid, x + 1 AS donor FROM dn WHERE x < n)"""
SCORES = "1 - sum((target - prediction) ^ 2) / (var_pop(target) * count(target))"


def importance_sql(target, end="", spec=SPEC):
    """Both importances of each feature (``im``) and the scores of the test rows (``sc``)."""
    return f"""{forest_sql(target, end, spec)},
tx{end} AS (SELECT position AS id, xs FROM fl{end} WHERE is_test),
{predictions_sql(f'tx{end}', f'p0{end}', end)},
sc{end} AS (SELECT {SCORES} AS r2, avg(abs(target - prediction)) AS mae FROM p0{end} p JOIN fl{end} fl ON fl.position = p.id),
sw{end} AS (SELECT (pm.repeat * {len(I.FEATURES)} + f) * 100000000 + rid AS id, list_transform(a.xs, lambda x, i: CASE WHEN i = f + 1 THEN b.xs[i] ELSE x END) AS xs
    FROM pm JOIN fl{end} a ON a.position = rid JOIN fl{end} b ON b.position = donor, range(0, {len(I.FEATURES)}) r(f)),
{predictions_sql(f'sw{end}', f'p1{end}', end)},
ps{end} AS (SELECT id // 100000000 % {len(I.FEATURES)} AS f, {SCORES} AS r2 FROM p1{end} p JOIN fl{end} fl ON fl.position = p.id % 100000000 GROUP BY id // 100000000),
gs{end} AS (SELECT f, sum(share) AS share FROM (SELECT tree, f, sum(gain) / sum(sum(gain)) OVER (PARTITION BY tree) AS share FROM inn{end} GROUP BY tree, f) GROUP BY f),
ii{end} AS (SELECT f, 'f' || (f + 1) AS feature, coalesce(share, 0) / (SELECT sum(share) FROM gs{end}) AS impurity_importance
    FROM range(0, {len(I.FEATURES)}) r(f) LEFT JOIN gs{end} USING (f)),
im{end} AS (SELECT ii.feature, impurity_importance, (SELECT r2 FROM sc{end}) - pi.r2 AS permutation_importance
    FROM ii{end} ii JOIN (SELECT f, avg(r2) AS r2 FROM ps{end} GROUP BY f) pi USING (f))"""


BASE = (MX, CHOSEN, PLACE, MEDIANS)
RATING, POWER, WHOLE_RATING = importance_sql("rating"), importance_sql("laser_power", "2"), importance_sql("rating", spec=WHOLE)


def fitted(spark, sf, target="rating", spec=SPEC):
    """Split rows, input names and the forest; the queries on one forest of a session fit it once."""
    key = (spark.sparkContext.applicationId, sf, target, spec)
    if key not in FITTED:
        FITTED[key] = _fit(spark, sf, target, spec)
    return FITTED[key]


def _fit(spark, sf, target, spec):
    filled, names = imp.model_inputs(I.matrix(spark, sf))
    parts = imp.pin(imp.split(filled, ["epoch"]))
    return parts, names, imp.fit_forest(parts.where(~F.col("is_test")), names, target, spec)


@query("M2_forest_size", """SELECT (SELECT count(*) FROM tr) AS n_train, count(DISTINCT tree)::INT AS n_trees, count(*) AS n_nodes,
    (SELECT count(*) FROM inn) AS n_splits, max(floor(log2(node)))::INT AS depth FROM nd""", (*BASE, forest_sql("rating")))
def m2(spark, sf):
    """Trees, nodes and depth of the fitted forest beside the rows it was fitted on."""
    parts, _, model = fitted(spark, sf)
    n_train = parts.where("not is_test").agg(F.count(F.lit(1))).scalar()
    return model.trees.select(F.explode(F.arrays_zip("path", "feature")).alias("n")).agg(
        n_train.alias("n_train"), F.lit(model.n_trees).alias("n_trees"), F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("n.feature") >= 0).alias("n_splits"), F.floor(F.log2(F.max("n.path"))).cast("int").alias("depth"))


@query("M3_predict", f"SELECT id AS rid, {rnd('target', 6)} AS y, {rnd('prediction', 6)} AS prediction FROM p0 JOIN fl ON fl.position = id",
       (*BASE, forest_sql("rating"), "tx AS (SELECT position AS id, xs FROM fl WHERE is_test)", predictions_sql("tx", "p0")))
def m3(spark, sf):
    parts, names, model = fitted(spark, sf)
    return rounded(imp.predict(model, imp.with_values(parts, names, "rating")).select("rid", "y", "prediction"), 6)


@query("M4_impurity_importance", f"SELECT feature, {rnd('impurity_importance', 6)} AS impurity_importance FROM ii", (*BASE, DONORS, RATING))
def m4(spark, sf):
    parts, names, model = fitted(spark, sf)
    return rounded(imp.impurity_importance(parts, model, names), 6)


@query("M5_permutation_importance", f"SELECT feature, {rnd('permutation_importance', 6)} AS permutation_importance FROM im", (*BASE, DONORS, WHOLE_RATING))
def m5(spark, sf):
    parts, names, model = fitted(spark, sf, spec=WHOLE)
    return rounded(imp.permutation_importance(model, imp.with_values(parts, names, "rating"), names, WHOLE), 6)


@query("M6_rank_importance", f"""SELECT 'laser_power' AS target, feature, {rnd('impurity_importance', 6)} AS impurity_importance,
    {rnd('permutation_importance', 6)} AS permutation_importance, {rnd('r2', 6)} AS r2, {rnd('mae', 6)} AS mae FROM im2, sc2""", (*BASE, DONORS, POWER))
def m6(spark, sf):
    filled, names = imp.model_inputs(I.matrix(spark, sf))
    table, scores = imp.rank_importance(filled, names, ["epoch"], "laser_power", SPEC)
    return rounded(table.join(scores, "target"), 6)


@query("M7_two_targets", """SELECT feature, a.r AS pain_rating_rank, b.r AS stimulus_rank, b.r - a.r AS rank_shift FROM
    (SELECT feature, rank() OVER (ORDER BY permutation_importance DESC) + (count(*) OVER (PARTITION BY permutation_importance) - 1) / 2 AS r FROM im) a
    JOIN (SELECT feature, rank() OVER (ORDER BY permutation_importance DESC) + (count(*) OVER (PARTITION BY permutation_importance) - 1) / 2 AS r FROM im2) b
    USING (feature)""", (*BASE, DONORS, RATING, POWER))
def m7(spark, sf):
    filled, names = imp.model_inputs(I.matrix(spark, sf))
    both = [imp.rank_importance(filled, names, ["epoch"], t, SPEC)[0] for t in ("rating", "laser_power")]
    return imp.compare_targets(*both)


@query("J10_permutations_per_repeat", "SELECT repeat, rid, donor FROM pm", (MX, CHOSEN, PLACE, DONORS))
def j10(spark, sf):
    parts = imp.split(imp.labelled(I.matrix(spark, sf)), ["epoch"])
    return imp.permutations(parts.where("is_test").select(F.col("position").alias("rid")), SPEC.repeats, SPEC.seed).select("repeat", "rid", "donor")


@query("W2_random_positions", "SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (ORDER BY md5('7|' || l_orderkey || '|' || l_partkey || '|' || l_linenumber)) AS position FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem)")
def random_positions(spark, sf):
    """Distributed numbering of a whole table in a seeded random order, as split and permutations use it."""
    key = ["l_orderkey", "l_partkey", "l_linenumber"]
    rows = I.table(spark, sf, "lineitem").select(*key).distinct()
    return digest_position(rows.withColumn("d", shuffle_digest(7, *[F.col(k) for k in key])), "d").select(*key, "position")


@query("J3_concat_by_feature", "SELECT coalesce(cr.feature, cp.feature) AS feature, cr.value AS impurity_importance, cp.value AS permutation_importance FROM cr FULL JOIN cp ON cr.feature = cp.feature", (MX, CR, CP))
def j3(spark, sf):
    a = correlations(spark, sf, "rating").withColumnRenamed("value", "impurity_importance")
    return a.join(correlations(spark, sf, "laser_power").withColumnRenamed("value", "permutation_importance"), "feature", "full")


@query("J4_aligned_ranks", "SELECT ra.feature, ra.r AS pain_rating_rank, rb.r AS stimulus_rank, rb.r - ra.r AS rank_shift FROM ra FULL JOIN rb ON ra.feature = rb.feature", (MX, CR, CP, RANKED))
def j4(spark, sf):
    return imp.compare_targets(correlations(spark, sf, "rating"), correlations(spark, sf, "laser_power"), "value")


@query("W3_rank_shift", "SELECT ra.feature, rb.r - ra.r AS rank_shift FROM ra JOIN rb ON ra.feature = rb.feature", (MX, CR, CP, RANKED))
def w3(spark, sf):
    return imp.compare_targets(correlations(spark, sf, "rating"), correlations(spark, sf, "laser_power"), "value").select("feature", "rank_shift")


@query("J5_reindex", "SELECT cr.feature, cr.value AS x, cp.value AS y FROM cr LEFT JOIN (SELECT * FROM cp WHERE feature <> 'f22') cp ON cr.feature = cp.feature", (MX, CR, CP))
def j5(spark, sf):
    second = correlations(spark, sf, "laser_power").where("feature <> 'f22'")
    return imp.side_by_side(correlations(spark, sf, "rating"), second, "value")


@query("A27_axis_limit", f"SELECT {rnd('greatest(max(cr.value), max(cp.value)) * 1.1', 8)} AS lim FROM cr JOIN cp ON cr.feature = cp.feature", (MX, CR, CP))
def a27(spark, sf):
    both = imp.side_by_side(correlations(spark, sf, "rating"), correlations(spark, sf, "laser_power"), "value")
    return rounded(imp.axis_limit(both), 8)


@query("T5_top_importances", "SELECT feature, value FROM cr ORDER BY value DESC, feature LIMIT 10", (MX, CR))
def t5(spark, sf):
    return imp.top(correlations(spark, sf, "rating"), 10, "value")
