"""Queries on manifests, participants, events, labels and sidecars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoq import config
from evoq.functions import numbers, text
from evoq.operators import channels, erp, ranking, summaries
from evoq.plans import reports
from evoq.session import scratch_path
from evoq.sources import labels as label_source
from evoq.sources import manifest as objects
from evoq.sources import sidecars as jsons
from evoq.sources import tables
from testbed import inputs as I
from testbed.registry import query, rnd, rounded

LB, PT, MF, SC = I.LABELS_SQL, I.PARTICIPANTS_SQL, I.MANIFEST_SQL, I.SIDECARS_SQL


# ------------------------------------------------------------------ sources and sinks

@query("S1_list_under_prefix", "SELECT key, size FROM mf WHERE starts_with(key, 'dsen/')", (MF,))
def s1(spark, sf):
    path = scratch_path(spark, "inventory")
    I.manifest_keys(spark, sf).write.parquet(path)
    return objects.under_prefix(objects.from_inventory(spark.read.parquet(path)), "dsen/")


@query("S1_list_written_objects", """SELECT 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS prefix, true AS has_bytes, count(*) AS n_objects
    FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY ALL UNION ALL SELECT '_SUCCESS', false, 1""")
def s1_written(spark, sf):
    """A small file per (lang, source) is written, and the folder is listed level by level, with its empty end mark."""
    path = scratch_path(spark, "objects")
    I.table(spark, sf, "documents").groupBy("lang", "source").count().write.partitionBy("lang", "source").parquet(path)
    found = objects.list_all_objects(spark, path).where(~F.col("key").endswith(".crc"))
    return found.groupBy(F.split("key", "/")[0].alias("prefix"), (F.col("size") > 0).alias("has_bytes")).agg(F.count(F.lit(1)).alias("n_objects"))


@query("S2_missing_datasets", """SELECT accession FROM (SELECT 'ds' || lang AS accession FROM documents UNION
    SELECT 'ds' || source FROM documents) WHERE accession NOT IN (SELECT dataset FROM mf)""", (MF,))
def s2(spark, sf):
    d = I.table(spark, sf, "documents")
    named = d.select(F.explode(F.array(F.concat(F.lit("ds"), "lang"), F.concat(F.lit("ds"), "source"))).alias("accession"))
    return objects.missing_datasets(named.distinct(), I.manifest(spark, sf))


@query("S3_participants_tsv", 'SELECT participant_id, dataset, "Gender", "Age" FROM pt', (PT,))
def s3(spark, sf):
    """Participants written as one tab-separated file set per dataset, one of them without ages, and scanned."""
    p, path = I.participants(spark, sf), scratch_path(spark, "participants")
    with_age = F.col("dataset") != "ASIA"
    for name, part in (("aged", p.where(with_age)), ("ageless", p.where(~with_age).drop("Age"))):
        part.write.partitionBy("dataset").options(sep="\t", header=True, nullValue="n/a").csv(f"{path}/{name}")
    found = {r: f"{path}/{'ageless' if r == 'ASIA' else 'aged'}/dataset={r}"
             for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "NOWHERE")}
    return tables.read_participants(spark, found).select("participant_id", "dataset", "Gender", "Age")


@query("S4_event_files_tsv", """SELECT 'sub-' || user_id AS subject, 'ds1' AS dataset, event_id AS sample,
    CASE WHEN event_type <> 'error' THEN event_type END AS value, round(value, 6) AS duration FROM events""")
def s4(spark, sf):
    path = scratch_path(spark, "bids") + "/ds1"
    e = I.raw_events(spark, sf).select(
        "subject", F.col("onset"), F.col("value").alias("duration"), F.col("event_id").alias("sample"),
        F.when(F.col("dataset") != "error", F.col("dataset")).alias("value"), F.col("event_id").alias("trial"))
    tables.write_by(e, "subject", "sample", path)
    read = tables.read_event_files(spark, path, glob="*.csv")
    return rounded(read.select("subject", "dataset", "sample", "value", "duration"), 6)


@query("S5_sidecar_json", """SELECT key, json_valid(content) AS is_json,
    CASE WHEN json_valid(content) THEN (content->>'$.k')::INT END AS k FROM sc""", (SC,))
def s5(spark, sf):
    return jsons.parsed(I.sidecars(spark, sf)).select(
        "key", F.col("json").isNotNull().alias("is_json"), F.try_variant_get("json", "$.k", "int").alias("k"))


MATRIX_SCHEMA = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("epoch", T.LongType()),
                              *[T.StructField(f, T.DoubleType()) for f in (*I.FEATURES, "rating", "laser_power")]])


@query("S6_feature_csv", f"SELECT dataset, epoch, {', '.join(I.FEATURES)}, rating, laser_power FROM mx", (I.MATRIX_SQL,))
def s6(spark, sf):
    path = scratch_path(spark, "features")
    tables.write_csv(I.matrix(spark, sf), path)
    return tables.read_features_csv(spark, path, MATRIX_SCHEMA)


@query("S7_label_scan", "SELECT dataset, subject, event_pos, type, epoch::INT AS epoch, rating, laser_power, NULL::VARCHAR AS code FROM lb", (LB,))
def s7(spark, sf):
    path = scratch_path(spark, "labels")
    I.raw_labels(spark, sf).write.json(path)
    return label_source.coerce(label_source.read_labels(spark, path)).select(
        "dataset", "subject", "event_pos", "type", "epoch", "rating", "laser_power", "code")


@query("S10_sinks", """SELECT dataset, 'parquet' AS sink, count(*) AS n FROM mx GROUP BY dataset UNION ALL
    SELECT dataset, 'csv', count(*) FROM mx GROUP BY dataset UNION ALL SELECT 'all', 'csv', count(*) FROM mx""", (I.MATRIX_SQL,))
def s10(spark, sf):
    m, path = I.matrix(spark, sf), scratch_path(spark, "sink")
    tables.write_parquet(m, f"{path}/parquet")
    tables.write_csv(m, f"{path}/csv", by="dataset")
    tables.write_csv(m, f"{path}/all")
    count = lambda df, sink: df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select("dataset", F.lit(sink).alias("sink"), "n")
    whole = tables.read_features_csv(spark, f"{path}/all", MATRIX_SCHEMA).withColumn("dataset", F.lit("all"))
    return count(spark.read.parquet(f"{path}/parquet"), "parquet") \
        .unionAll(count(spark.read.csv(f"{path}/csv", header=True), "csv")).unionAll(count(whole, "csv"))


def _values(rows):
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)


@query("S12_feature_reference", f"""SELECT i.feature, description, source, n FROM (VALUES {_values(config.FEATURE_INFO)}) i(feature, description, source)
    LEFT JOIN (SELECT unnest(['n2_amp', 'n2_lat', 'p2_amp', 'p2_lat', 'n2p2_amp']) AS feature, count(*) AS n FROM embeddings) m
    ON m.feature = i.feature""")
def s12(spark, sf):
    """The reference table beside the number of epochs that have each peak feature."""
    peaks = erp.with_peaks(I.epochs(spark, sf), I.SPEC)
    names = ["n2_amp", "n2_lat", "p2_amp", "p2_lat", "n2p2_amp"]
    present = summaries.to_long(peaks, [], names).groupBy("feature").agg(F.count("value").alias("n"))
    return config.feature_info_table(spark).join(present, "feature", "left")


# ------------------------------------------------------------------ filters and projections

@query("P1_suffix_filter", """SELECT key FROM mf WHERE suffix(key, '_events.json') OR suffix(key, '_events.tsv')
    OR suffix(key, '.set') OR suffix(key, '.vhdr')""", (MF,))
def p1(spark, sf):
    return I.manifest(spark, sf).where(objects.ends_with_any(F.col("key"), ["_events.json", "_events.tsv", ".set", ".vhdr"])).select("key")


@query("P2_substring_filters", """SELECT key, contains(lower(key), 'derivatives') AS derived, contains(key, '/derivatives/rerefer/') AS rerefer,
    contains(lower(basename), 'beh') AS behaviour, contains(key, subject) AS own FROM mf""", (MF,))
def p2(spark, sf):
    k = F.col("key")
    return I.manifest(spark, sf).select("key", F.lower(k).contains("derivatives").alias("derived"), objects.in_derivative(k).alias("rerefer"),
                                        objects.is_behaviour_file(k).alias("behaviour"), k.contains(F.col("subject")).alias("own"))


@query("P3_fallback_filter", """SELECT key FROM (SELECT key, contains(lower(key), 'derivatives') AS d,
    bool_or(contains(lower(key), 'derivatives')) OVER (PARTITION BY dataset) AS has FROM mf WHERE suffix(key, '.set')) WHERE d OR NOT has""", (MF,))
def p3(spark, sf):
    return objects.preferred_sets(I.manifest(spark, sf)).select("key")


@query("P4_constant_and_derived", """SELECT key, 'ds-all' AS collection, subject, basename AS source_file FROM mf""", (MF,))
def p4(spark, sf):
    k = F.col("key")
    return I.manifest_keys(spark, sf).select("key", F.lit("ds-all").alias("collection"), text.subject_of(k).alias("subject"),
                                             text.basename_of(k).alias("source_file"))


@query("P5_coerce_to_number", "SELECT subject, event_pos, rating, laser_power FROM lb", (LB,))
def p5(spark, sf):
    return I.raw_labels(spark, sf).select("subject", "event_pos", numbers.to_number(F.col("rating")).alias("rating"),
                                          numbers.to_number(F.col("laser_power")).alias("laser_power"))


@query("P6_drop_nulls", "SELECT subject, event_pos, rating FROM lb WHERE rating IS NOT NULL", (LB,))
def p6(spark, sf):
    return I.labels(spark, sf).where(F.col("rating").isNotNull()).select("subject", "event_pos", "rating")


@query("P7_labelled_subset", """SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def p7(spark, sf):
    from evoq.plans.importance import labelled
    d = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    return labelled(d, ("quality", "toxic")).select("doc_id", "lang", "quality", "toxic")


@query("P8_valid_pairs", "SELECT dataset, laser_power AS x, rating AS y FROM lb WHERE laser_power IS NOT NULL AND rating IS NOT NULL", (LB,))
def p8(spark, sf):
    return summaries.valid_pairs(I.labels(spark, sf), "laser_power", "rating").select("dataset", F.col("laser_power").alias("x"), F.col("rating").alias("y"))


@query("P14_feature_columns", f"SELECT {', '.join(I.FEATURES)} FROM mx", (I.MATRIX_SQL,))
def p14(spark, sf):
    from evoq.plans.importance import feature_names
    m = I.matrix(spark, sf)
    return m.select(*feature_names(m.columns))


@query("P15_zero_ratings", "SELECT dataset, subject, event_pos, laser_power FROM lb WHERE rating = 0", (LB,))
def p15(spark, sf):
    return I.labels(spark, sf).where(F.col("rating") == 0).select("dataset", "subject", "event_pos", "laser_power")


@query("P16_guess_column", """SELECT 'c_acctbal' AS column_name, c_acctbal AS value FROM customer""")
def p16(spark, sf):
    c = I.table(spark, sf, "customer")
    name = text.guess_column(c.columns, ["balance", "bal"])
    return c.select(F.lit(name).alias("column_name"), F.col(name).alias("value"))


@query("P22_transpose", f"SELECT epoch, feature, value FROM (SELECT epoch, {', '.join(I.FEATURES)} FROM mx) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(I.FEATURES)}))", (I.MATRIX_SQL,))
def p22(spark, sf):
    return summaries.to_long(I.matrix(spark, sf), ["epoch"], I.FEATURES)


@query("P23_empty_inputs", """SELECT dataset, count(rating) AS count FROM lb GROUP BY dataset""", (LB,))
def p23(spark, sf):
    """A dataset without rows adds nothing and fails nothing."""
    rows = I.labels(spark, sf)
    none = rows.where(F.col("dataset") == "absent")
    both = tables.union_all(spark, [summaries.describe(d, ["dataset"], "rating") for d in (none, rows)], "dataset string, count bigint")
    return both.select("dataset", "count").unionByName(tables.union_all(spark, [], "dataset string, count bigint"))


# ------------------------------------------------------------------ joins on keys

@query("J6_sibling_files", """SELECT a.key, b.key AS fdt_key FROM mf a LEFT JOIN (SELECT * FROM mf WHERE suffix(key, '.fdt')) b ON a.stem = b.stem
    WHERE suffix(a.key, '.set')""", (MF,))
def j6(spark, sf):
    m = I.manifest(spark, sf)
    return objects.with_sibling(m.where(F.col("key").endswith(".set")), m, ".fdt", "fdt_key").select("key", "fdt_key")


@query("J6_existing_siblings", "SELECT key FROM mf WHERE suffix(key, '.set') AND stem IN (SELECT stem FROM mf WHERE suffix(key, '.fdt'))", (MF,))
def j6_semi(spark, sf):
    m = I.manifest(spark, sf)
    return objects.having_sibling(m.where(F.col("key").endswith(".set")), m, ".fdt").select("key")


# ------------------------------------------------------------------ aggregations

@query("A1_group_count", """SELECT 'dataset' AS level, dataset AS key, count(*) AS n FROM pt GROUP BY dataset UNION ALL
    SELECT 'sex', dataset || '/' || "Gender", count(*) FROM pt GROUP BY dataset, "Gender" """, (PT,))
def a1(spark, sf):
    p = I.participants(spark, sf)
    one = summaries.group_count(p, ["dataset"]).select(F.lit("dataset").alias("level"), F.col("dataset").alias("key"), "n")
    two = summaries.group_count(p, ["dataset", "Gender"]).select(F.lit("sex").alias("level"), F.concat_ws("/", "dataset", "Gender").alias("key"), "n")
    return one.unionAll(two)


@query("A2_count_distinct", "SELECT event_type AS dataset, count(DISTINCT user_id) AS n_subjects FROM events GROUP BY event_type")
def a2(spark, sf):
    return I.raw_events(spark, sf).groupBy("dataset").agg(F.countDistinct("subject").alias("n_subjects"))


BASIC = "count({v}) AS count, " + ", ".join(f"{rnd(e, 6)} AS {n}" for n, e in
                                           (("mean", "avg({v})"), ("std", "stddev_samp({v})"), ("min", "min({v})"), ("max", "max({v})")))


@query("A3_describe", f"SELECT dataset, {BASIC.format(v='Age')} FROM pt GROUP BY dataset", (PT,))
def a3(spark, sf):
    return rounded(summaries.describe(I.participants(spark, sf), ["dataset"], "Age"), 6)


QUARTILES = ", ".join(f"{rnd(f'quantile_cont({{v}}, {q})', 6)} AS {n}" for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))


@query("A4_describe_full", f"SELECT dataset, {BASIC.format(v='laser_power')}, {QUARTILES.format(v='laser_power')} FROM lb GROUP BY dataset", (LB,))
def a4(spark, sf):
    return rounded(summaries.describe(I.labels(spark, sf), ["dataset"], "laser_power", full=True), 6)


@query("A4_describe_prices", f"SELECT {BASIC.format(v='l_extendedprice')}, {QUARTILES.format(v='l_extendedprice')} FROM lineitem")
def a4_prices(spark, sf):
    """The same over one ungrouped column of mostly distinct values."""
    return rounded(summaries.describe(I.table(spark, sf, "lineitem"), [], "l_extendedprice", full=True), 6)


TRIALS = "tr AS (SELECT dataset, subject, count(*) AS n_trials FROM lb GROUP BY dataset, subject)"


@query("A5_two_level", f"SELECT dataset, {BASIC.format(v='n_trials')} FROM tr GROUP BY dataset", (LB, TRIALS))
def a5(spark, sf):
    return rounded(summaries.describe(summaries.trials_per_subject(I.labels(spark, sf)), ["dataset"], "n_trials")
                   .withColumns({c: F.col(c).cast("double") for c in ("min", "max")}), 6)


CROSSTAB = ", ".join(f"count(*) FILTER (WHERE \"Gender\" = '{s}') AS \"{s}\"" for s in I.SEXES) \
    + f', count(*) FILTER (WHERE "Gender" NOT IN {tuple(I.SEXES)}) AS other'


@query("A6_crosstab", f"SELECT dataset, {CROSSTAB} FROM pt GROUP BY dataset", (PT,))
def a6(spark, sf):
    return summaries.crosstab(I.participants(spark, sf), "dataset", "Gender", I.SEXES)


def histogram_sql(source, value, bins):
    edge = lambda i: f"CASE WHEN {i} = {bins} THEN hi ELSE lo + ({i}) * ((hi - lo) / {bins}) END"
    return f"""hk AS (SELECT dataset, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
hr AS (SELECT dataset, count(*) AS total, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
    CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM hk GROUP BY dataset),
hg AS (SELECT hk.dataset, v, lo, hi, least(floor((v - lo) * ({bins} / (hi - lo)))::INT, {bins - 1}) AS g FROM hk JOIN hr ON hk.dataset = hr.dataset),
hn AS (SELECT dataset, CASE WHEN v < {edge('g')} THEN g - 1 WHEN v >= {edge('g + 1')} AND g < {bins - 1} THEN g + 1 ELSE g END AS bin,
    count(*) AS n FROM hg GROUP BY 1, 2),
hist AS (SELECT hr.dataset, b::INT AS bin, {edge('b')} AS low, {edge('b + 1')} AS high, coalesce(n, 0) AS n,
    coalesce(n, 0) / (total * ({edge('b + 1')} - ({edge('b')}))) AS density FROM hr CROSS JOIN range(0, {bins}) r(b)
    LEFT JOIN hn ON hn.dataset = hr.dataset AND hn.bin = b)"""


HIST_COLUMNS = f"dataset, bin, {rnd('low')} AS low, {rnd('high')} AS high, n, {rnd('density')} AS density"


@query("A7_histogram_age", f"SELECT {HIST_COLUMNS} FROM hist", (PT, histogram_sql("pt", '"Age"', 15)))
def a7_age(spark, sf):
    return rounded(summaries.equal_width_histogram(I.participants(spark, sf), "dataset", "Age", 15))


@query("A7_histogram_power", f"SELECT {HIST_COLUMNS} FROM hist", (LB, histogram_sql("lb", "laser_power", 20)))
def a7_power(spark, sf):
    return rounded(summaries.equal_width_histogram(I.labels(spark, sf), "dataset", "laser_power", 20))


def unit_histogram_sql(source, value):
    return f"""uk AS (SELECT dataset, least(floor({value})::INT, 10) AS bin, count(*) AS n FROM {source} WHERE {value} BETWEEN 0 AND 11 GROUP BY 1, 2),
uhist AS (SELECT t.dataset, b::INT AS bin, coalesce(n, 0) AS n, coalesce(n, 0) / total AS density FROM
    (SELECT dataset, sum(n) AS total FROM uk GROUP BY dataset) t CROSS JOIN range(0, 11) r(b) LEFT JOIN uk ON uk.dataset = t.dataset AND uk.bin = b)"""


@query("A8_histogram_rating", f"SELECT dataset, bin, n, {rnd('density')} AS density FROM uhist", (LB, unit_histogram_sql("lb", "rating")))
def a8(spark, sf):
    return rounded(summaries.unit_histogram(I.labels(spark, sf), "dataset", "rating"))


@query("A8_histogram_out_of_range", f"SELECT dataset, bin, n, {rnd('density')} AS density FROM uhist",
       ("qt AS (SELECT l_returnflag AS dataset, l_quantity / 2 AS v FROM lineitem)", unit_histogram_sql("qt", "v")))
def a8_outside(spark, sf):
    """Values above 11 fall out of counts and densities."""
    q = I.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_quantity") / 2).alias("v"))
    return rounded(summaries.unit_histogram(q, "dataset", "v"))


BOX = """bq AS (SELECT dataset, quantile_cont(n_trials, 0.25) AS q1, quantile_cont(n_trials, 0.5) AS median, quantile_cont(n_trials, 0.75) AS q3
    FROM tr GROUP BY dataset),
box AS (SELECT tr.dataset, q1, median, q3, min(n_trials) FILTER (WHERE n_trials BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
    max(n_trials) FILTER (WHERE n_trials BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high,
    count(*) FILTER (WHERE n_trials NOT BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS n_outliers
    FROM tr JOIN bq ON tr.dataset = bq.dataset GROUP BY ALL)"""


@query("A9_box_plot", "SELECT * FROM box", (LB, TRIALS, BOX))
def a9(spark, sf):
    return summaries.box_stats(summaries.trials_per_subject(I.labels(spark, sf)), "dataset", "n_trials")


PEARSON = """SELECT dataset, count(*) AS n, corr(laser_power, rating) AS r FROM lb WHERE laser_power IS NOT NULL AND rating IS NOT NULL
    GROUP BY dataset HAVING count(*) > 2"""


@query("A10_pearson", f"SELECT dataset, n, {rnd('r')} AS r FROM ({PEARSON})", (LB,))
def a10(spark, sf):
    return rounded(summaries.pearson(I.labels(spark, sf), "dataset", "laser_power", "rating"))


@query("A10_pearson_no_variance", """SELECT l_orderkey::VARCHAR AS dataset, count(*) AS n,
    round(CASE WHEN stddev_pop(l_discount) > 1e-12 AND stddev_pop(l_quantity) > 1e-12 THEN corr(l_quantity, l_discount) END, 6) + 0.0::DOUBLE AS r
    FROM lineitem GROUP BY l_orderkey HAVING count(*) > 2""")
def a10_constant(spark, sf):
    """Small groups, some without variance: NULL there, no error."""
    rows = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("dataset"), "l_quantity", "l_discount")
    return rounded(summaries.pearson(rows, "dataset", "l_quantity", "l_discount"), 6)


@query("A11_share_pct", f"SELECT dataset, {rnd('100.0 * count(*) FILTER (WHERE rating = 0) / greatest(count(*), 1)', 6)} AS zero_pct FROM lb GROUP BY dataset", (LB,))
def a11(spark, sf):
    return rounded(I.labels(spark, sf).groupBy("dataset").agg(summaries.share_pct(F.col("rating") == 0).alias("zero_pct")), 6)


@query("A12_value_counts_by_key", "SELECT epoch::INT AS epoch, count(*) AS n FROM lb WHERE rating = 0 AND epoch IS NOT NULL GROUP BY epoch ORDER BY epoch LIMIT 10", (LB,))
def a12(spark, sf):
    return summaries.value_counts(I.labels(spark, sf).where("rating = 0"), "epoch").orderBy("epoch").limit(10)


@query("A13_fraction_at_minimum", f"""SELECT {rnd('avg(coalesce((epoch = (SELECT min(epoch) FROM lb WHERE rating = 0))::INT, 0))')} AS fraction_at_min
    FROM lb WHERE rating = 0""", (LB,))
def a13(spark, sf):
    return rounded(summaries.fraction_at_minimum(I.labels(spark, sf).where("rating = 0"), "epoch"))


@query("A14_group_size_stats", f"""SELECT {rnd('avg(n)')} AS mean_size, count(*) FILTER (WHERE n = 1) AS n_single, count(*) AS n_groups FROM
    (SELECT count(*) AS n FROM lb WHERE rating = 0 GROUP BY dataset, subject)""", (LB,))
def a14(spark, sf):
    return rounded(summaries.group_size_stats(I.labels(spark, sf).where("rating = 0"), ["dataset", "subject"]))


MEDIANS = " UNION ALL ".join(f"SELECT '{f}' AS feature, median({f}) AS median FROM mx" for f in I.FEATURES)


@query("A19_column_medians", f"SELECT feature, {rnd('median')} AS median FROM ({MEDIANS})", (I.MATRIX_SQL,))
def a19(spark, sf):
    return rounded(summaries.medians(I.matrix(spark, sf), I.FEATURES))


@query("A20_missing_report", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) - count({f}) AS n_missing, {rnd(f'(count(*) - count({f})) / count(*)')} AS missing_share FROM mx" for f in I.FEATURES), (I.MATRIX_SQL,))
def a20(spark, sf):
    return rounded(summaries.missing_report(I.matrix(spark, sf), I.FEATURES))


@query("A21_r2_and_mae", f"""SELECT {rnd('1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y))')} AS r2, {rnd('avg(abs(y - p))', 6)} AS mae FROM
    (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)""")
def a21(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    return rounded(rounded(summaries.regression_scores(rows, "y", "p"), 9, "r2"), 6, "mae")


@query("A23_files_by_derivative", """SELECT dataset, derivative, count(*) AS n_files, min(key) AS first_key FROM mf WHERE suffix(key, '.set')
    GROUP BY dataset, derivative""", (MF,))
def a23(spark, sf):
    return objects.by_derivative(I.manifest(spark, sf).where(F.col("key").endswith(".set")))


@query("A24_row_and_column_counts", "SELECT count(*) AS n_rows, 26 AS n_columns FROM mx", (I.MATRIX_SQL,))
def a24(spark, sf):
    m = I.matrix(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(m.columns)))


@query("A25_labelled_per_dataset", """SELECT dataset, count(*) AS n FROM mx WHERE rating IS NOT NULL AND laser_power IS NOT NULL GROUP BY dataset ORDER BY n DESC""", (I.MATRIX_SQL,))
def a25(spark, sf):
    from evoq.plans.importance import labelled
    return summaries.value_counts(labelled(I.matrix(spark, sf)), "dataset").orderBy(F.desc("n"), "dataset")


# ------------------------------------------------------------------ ranks, sorts, limits, sets

@query("W2_average_rank", """SELECT DISTINCT l_quantity, rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rank
    FROM lineitem""")
def w2(spark, sf):
    return ranking.average_rank(I.table(spark, sf, "lineitem"), "l_quantity")


@query("W2_average_rank_in_groups", """SELECT DISTINCT dataset, "Age", rank() OVER (PARTITION BY dataset ORDER BY "Age") + (count(*) OVER (PARTITION BY dataset, "Age") - 1) / 2 AS rank
    FROM pt WHERE "Age" IS NOT NULL""", (PT,))
def w2_groups(spark, sf):
    return ranking.average_rank(I.participants(spark, sf), "Age", by=["dataset"], descending=False)


@query("T1_first_files_per_dataset", """SELECT dataset, key FROM mf WHERE contains(key, '/derivatives/rerefer/') AND suffix(key, '.set')
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY key) <= 3""", (MF,))
def t1(spark, sf):
    return ranking.first_per_group(objects.signal_files(I.manifest(spark, sf)), ["dataset"], [F.col("key")], 3).select("dataset", "key")


@query("T2_smallest_key", "SELECT dataset, min(key) AS first_key FROM mf GROUP BY dataset", (MF,))
def t2(spark, sf):
    return I.manifest(spark, sf).groupBy("dataset").agg(F.min("key").alias("first_key"))


@query("T3_first_subjects", """SELECT dataset, subject FROM (SELECT DISTINCT dataset, nullif(regexp_extract(key, '(sub-[A-Za-z0-9]+)/', 1), '') AS subject FROM mf)
    WHERE subject IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY subject) <= 3""", (MF,))
def t3(spark, sf):
    subjects = I.manifest(spark, sf).select("dataset", text.subject_folder_of(F.col("key")).alias("subject")).na.drop().distinct()
    return ranking.first_per_group(subjects, ["dataset"], [F.col("subject")], 3)


@query("T4_head", "SELECT epoch, dataset, rating, laser_power FROM mx ORDER BY epoch LIMIT 15", (I.MATRIX_SQL,))
def t4(spark, sf):
    return I.matrix(spark, sf).select("epoch", "dataset", "rating", "laser_power").orderBy("epoch").limit(15)


@query("T6_first_sidecar_contents", """SELECT dataset, nth::INT AS nth, key, substring(CASE WHEN json_valid(content) THEN json(content)::VARCHAR ELSE content END, 1, 1500) AS preview FROM
    (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY key) AS nth FROM
    (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY dataset, content ORDER BY key) = 1)) WHERE nth <= 2""", (SC,))
def t6(spark, sf):
    return jsons.first_contents(I.sidecars(spark, sf), 2)


@query("U1_union_differing_columns", """SELECT dataset, participant_id, "Age", NULL::DOUBLE AS onset, NULL::VARCHAR AS subject FROM pt UNION ALL
    SELECT event_type, NULL, NULL, round(epoch_us(ts) / 1e6, 3), 'sub-' || user_id FROM events""", (PT,))
def u1(spark, sf):
    e = I.raw_events(spark, sf).select("dataset", "onset", "subject")
    both = tables.union_all(spark, [I.participants(spark, sf).select("dataset", "participant_id", "Age"), e], "dataset string")
    return rounded(both, 3, "onset")


@query("U2_distinct_subjects", "SELECT DISTINCT dataset, subject FROM mf", (MF,))
def u2(spark, sf):
    return I.manifest(spark, sf).select("dataset", "subject").distinct()


@query("U3_distinct_contents", "SELECT dataset, sha256(content) AS digest, min(key) AS key, count(*) AS n_copies FROM sc GROUP BY dataset, content", (SC,))
def u3(spark, sf):
    return jsons.distinct_contents(I.sidecars(spark, sf))


@query("U4_append_subject_rows", """SELECT dataset, count(*) AS n FROM (SELECT dataset, subject FROM lb UNION ALL SELECT event_type, 'sub-' || user_id FROM events) GROUP BY dataset""", (LB,))
def u4(spark, sf):
    rows = tables.union_all(spark, [I.labels(spark, sf).select("dataset", "subject"), I.raw_events(spark, sf).select("dataset", "subject")], "dataset string, subject string")
    return summaries.group_count(rows, ["dataset"])


# ------------------------------------------------------------------ scalar functions

@query("F1_subject_label", "SELECT key, subject FROM mf", (MF,))
def f1(spark, sf):
    return I.manifest_keys(spark, sf).select("key", text.subject_of(F.col("key")).alias("subject"))


@query("F1b_subject_folder", "SELECT key, nullif(regexp_extract(key, '(sub-[A-Za-z0-9]+)/', 1), '') AS subject FROM mf", (MF,))
def f1b(spark, sf):
    return I.manifest_keys(spark, sf).select("key", text.subject_folder_of(F.col("key")).alias("subject"))


@query("F2_path_parts", "SELECT key, basename, derivative FROM mf", (MF,))
def f2(spark, sf):
    k = F.col("key")
    return I.manifest_keys(spark, sf).select("key", text.basename_of(k).alias("basename"), text.derivative_of(k).alias("derivative"))


@query("F2b_scalar_or_list", """SELECT l_orderkey::VARCHAR AS subject, count(*) AS n_events, max(n)::INT AS last_pos FROM (SELECT l_orderkey,
    row_number() OVER (PARTITION BY l_orderkey) - 1 AS n FROM lineitem) GROUP BY l_orderkey""")
def f2b(spark, sf):
    """Files with several events hold a list, files with one hold it bare; both become rows with their place."""
    event = F.struct(F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("rating"))
    lists = I.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(event).alias("events"))
    files = lists.select(F.lit("ds").alias("dataset"), F.col("l_orderkey").cast("string").alias("subject"),
                         F.when(F.size("events") > 1, F.col("events")).alias("events"),
                         F.when(F.size("events") == 1, F.get("events", F.lit(0))).alias("event"))
    return label_source.explode_events(files).groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("event_pos").alias("last_pos"))


@query("F2c_optional_fields", """SELECT subject, event_pos, coalesce(nullif(type, 'O'), 'unknown') AS channel, NULL::VARCHAR AS code, epoch::INT AS epoch FROM lb WHERE epoch IS NOT NULL""", (LB,))
def f2c(spark, sf):
    rows = label_source.coerce(I.raw_labels(spark, sf)).withColumn("code", F.lit(None).cast("string")) \
        .withColumn("channel", F.nullif(F.col("type"), F.lit("O")))
    return channels.labelled(rows.where(F.col("epoch").isNotNull())).select("subject", "event_pos", "channel", "code", "epoch")


@query("F3_replace_suffix", r"SELECT key, regexp_replace(key, '\.[^./]*$', '') || '.fdt' AS fdt_key FROM mf", (MF,))
def f3(spark, sf):
    return I.manifest_keys(spark, sf).select("key", text.with_suffix(F.col("key"), ".fdt").alias("fdt_key"))


@query("F4_case_and_match", "SELECT url, lower(html) = html AS is_lower, contains(lower(html), 'doctype') AS has_doctype, suffix(url, '.html') AS is_html FROM pages")
def f4(spark, sf):
    p = I.table(spark, sf, "pages")
    return p.select("url", (F.lower("html") == F.col("html")).alias("is_lower"), F.lower("html").contains("doctype").alias("has_doctype"),
                    F.col("url").endswith(".html").alias("is_html"))


@query("F5_decode_with_replacement", "SELECT doc_id, md5(text || chr(65533) || text) AS digest FROM documents")
def f5(spark, sf):
    raw = F.col("text").cast("binary")
    broken = F.concat(raw, F.lit(bytearray(b"\xff")), raw)
    return I.table(spark, sf, "documents").select("doc_id", F.md5(text.decode_text(broken).cast("binary")).alias("digest"))


@query("F6_json_preview", "SELECT key, md5(substring(CASE WHEN json_valid(content) THEN json(content)::VARCHAR ELSE content END, 1, 1500)) AS digest FROM sc", (SC,))
def f6(spark, sf):
    return I.sidecars(spark, sf).select("key", F.md5(text.json_preview(F.col("content")).cast("binary")).alias("digest"))


@query("F7_clamp", "SELECT l_orderkey, l_partkey, l_linenumber, least(greatest(l_quantity / 25, 0.25::DOUBLE), 1.5::DOUBLE) AS v FROM lineitem")
def f7(spark, sf):
    return I.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", numbers.clamp(F.col("l_quantity") / 25, 0.25, 1.5).alias("v"))


@query("F10_number_format", "SELECT l_orderkey, l_partkey, l_linenumber, printf('%.1f-%.1f', 30.0, l_quantity / 2) AS band FROM lineitem")
def f10(spark, sf):
    return I.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", numbers.band_label(30.0, F.col("l_quantity") / 2).alias("band"))


@query("F11_cast_to_double", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE END AS v FROM documents")
def f11(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")).otherwise(F.concat("lang", F.col("n_chars").cast("string")))
    return I.table(spark, sf, "documents").select("doc_id", numbers.to_number(raw).alias("v"))


# ------------------------------------------------------------------ reports

def long_sql(section, group, metrics, source):
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {group} AS \"group\", '{m}' AS metric, {rnd(f'({e})::DOUBLE', 6)} AS value FROM {source}" for m, e in metrics)


def described(v, full=False):
    out = [("count", f"count({v})"), ("mean", f"avg({v})"), ("std", f"stddev_samp({v})"), ("min", f"min({v})"), ("max", f"max({v})")]
    return out + [(n, f"quantile_cont({v}, {q})") for n, q in (("q25", .25), ("q50", .5), ("q75", .75))] if full else out


ZERO = "zr AS (SELECT * FROM lb WHERE rating = 0)"
X18 = " UNION ALL ".join([
    long_sql("totals", "'all'", [("n_trials", "count(*)"), ("n_zero", "count(*) FILTER (WHERE rating = 0)"),
                                 ("zero_pct", "100.0 * count(*) FILTER (WHERE rating = 0) / greatest(count(*), 1)")], "lb"),
    long_sql("epochs", "epoch::VARCHAR", [("n", "n")], "(SELECT epoch, count(*) AS n FROM zr WHERE epoch IS NOT NULL GROUP BY epoch ORDER BY epoch LIMIT 10)"),
    long_sql("at_minimum", "'all'", [("fraction_at_min", "avg(coalesce((epoch = (SELECT min(epoch) FROM zr))::INT, 0))")], "zr"),
    long_sql("power_of_zeros", "'all'", described("laser_power", True), "zr"),
    long_sql("power_of_all", "'all'", described("laser_power", True), "lb"),
    long_sql("per_subject", "'all'", [("mean_size", "avg(n)"), ("n_single", "count(*) FILTER (WHERE n = 1)"), ("n_groups", "count(*)")],
             "(SELECT count(*) AS n FROM zr GROUP BY dataset, subject)")])


@query("X18_zero_rating_report", X18, (LB, ZERO))
def x18(spark, sf):
    return rounded(reports.as_long(reports.zero_ratings(I.labels(spark, sf))), 6)


X19 = " UNION ALL ".join([
    long_sql("n_subjects", "dataset", [("n_subjects", "n")], "(SELECT dataset, count(*) AS n FROM pt GROUP BY dataset)"),
    long_sql("age", "dataset", [(m, f'"{m}"') for m, _ in described("Age")],
             "(SELECT dataset, " + ", ".join(f"{e} AS \"{m}\"" for m, e in described('"Age"')) + " FROM pt GROUP BY dataset)"),
    long_sql("age_histogram", "dataset || '/' || bin", [("n", "n")], "hist"),
    long_sql("sex", "dataset", [(s, f'"{s}"') for s in [*I.SEXES, "other"]], f"(SELECT dataset, {CROSSTAB} FROM pt GROUP BY dataset)")])


@query("X19_demographics_report", X19, (PT, histogram_sql("pt", '"Age"', 15)))
def x19(spark, sf):
    return rounded(reports.as_long(reports.demographics(I.participants(spark, sf), I.SEXES)), 6)


X20 = " UNION ALL ".join([
    long_sql("trials", "dataset", [(m, f'"{m}"') for m, _ in described("n")],
             "(SELECT dataset, " + ", ".join(f"{e} AS \"{m}\"" for m, e in described("n_trials")) + " FROM tr GROUP BY dataset)"),
    long_sql("trials_box", "dataset", [(m, m) for m in ("q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")], "box"),
    long_sql("rating_histogram", "dataset || '/' || bin", [("n", "n"), ("density", "density")], "uhist"),
    long_sql("power_histogram", "dataset || '/' || bin", [("n", "n"), ("density", "density")], "hist"),
    long_sql("correlation", "dataset", [("n", "n"), ("r", "r")], f"({PEARSON})")])


@query("X20_behaviour_report", X20, (LB, TRIALS, BOX, unit_histogram_sql("lb", "rating"), histogram_sql("lb", "laser_power", 20)))
def x20(spark, sf):
    return rounded(reports.as_long(reports.behaviour(I.labels(spark, sf))), 6)


X21 = """SELECT 'behaviour_counts' AS section, dataset, NULL AS item, count(*) AS n FROM mf WHERE contains(lower(basename), 'beh') GROUP BY dataset
UNION ALL SELECT 'behaviour_examples', dataset, key, NULL FROM (SELECT dataset, key FROM mf WHERE contains(lower(basename), 'beh')
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY key) <= 5)
UNION ALL SELECT 'derivatives', dataset, derivative || ' ' || min(key), count(*) FROM (SELECT *, contains(lower(key), 'derivatives') AS d,
    bool_or(contains(lower(key), 'derivatives')) OVER (PARTITION BY dataset) AS has FROM mf WHERE suffix(key, '.set')) WHERE d OR NOT has GROUP BY dataset, derivative
UNION ALL SELECT 'sidecar_counts', dataset, NULL, count(*) FROM mf WHERE suffix(key, '_events.json') GROUP BY dataset
UNION ALL SELECT 'sidecars', dataset, key, nth FROM (SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY key) AS nth FROM
    (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY dataset, content ORDER BY key) = 1)) WHERE nth <= 2"""


@query("X21_manifest_report", X21, (MF, SC))
def x21(spark, sf):
    parts = reports.stored_files(I.manifest(spark, sf), I.sidecars(spark, sf))
    none, no_n = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    item = {"behaviour_counts": (none, F.col("n_files")), "behaviour_examples": (F.col("key"), no_n),
            "derivatives": (F.concat_ws(" ", "derivative", "first_key"), F.col("n_files")),
            "sidecar_counts": (none, F.col("n_files")), "sidecars": (F.col("key"), F.col("nth").cast("bigint"))}
    frames = [parts[s].select(F.lit(s).alias("section"), "dataset", i.alias("item"), n.alias("n")) for s, (i, n) in item.items()]
    return tables.union_all(spark, frames, "section string")
