"""Engine inputs made from the given tables, and the same inputs as SQL for the checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evoq.config import BANDS, SignalSpec
from evoq.session import pin, scratch_path
from evoq.sources import labels as label_source
from evoq.sources import manifest as objects
from evoq.sources.stores import store_of

RATE, T0, N = 64.0, -26 / 64, 64

# The given vectors have 64 values: read as 64 Hz, gamma moves below the Nyquist cap and segments get shorter.
SPEC = SignalSpec(bands={**BANDS, "gamma": (20.0, 27.0)}, psd_segment=32, erd_segment=16,
                  dfa_sizes=(4, 5, 6, 8, 10, 12, 16))

MONTAGE = ["Cz", "Fz", "Pz", "C3", "C4", "FCz", "CPz"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _owner(epoch: Column) -> dict[str, Column]:
    return {"dataset": F.concat(F.lit("ds00"), (epoch % 5 + 1).cast("string")),
            "subject": F.concat(F.lit("sub-"), (epoch % 40).cast("string"))}


OWNER_SQL = "'ds00' || ({e} % 5 + 1) AS dataset, 'sub-' || ({e} % 40) AS subject"


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is the one channel of one epoch."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(*[c.alias(n) for n, c in _owner(F.col("vec_id")).items()], F.col("vec_id").cast("int").alias("epoch"),
                    F.lit(0).alias("channel_idx"), F.lit("Cz").alias("channel"), F.lit(RATE).alias("sfreq"),
                    F.lit(T0).alias("t0"), F.lit(N).alias("n_times"), F.col("embedding").cast("array<double>").alias("signal"))


EPOCHS_SQL = f"""ep AS (SELECT {OWNER_SQL.format(e='vec_id')}, vec_id::INT AS epoch,
    embedding::DOUBLE[] AS s FROM embeddings),
smp AS (SELECT dataset, subject, epoch, i - 1 AS i, {T0}::DOUBLE + (i - 1) / 64.0 AS t, s[i] AS v
    FROM ep, range(1, 65) r(i))"""


def montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch e has seven channels: the vectors e .. e + 6. One dataset writes names in lower case, one lacks CPz."""
    e = table(spark, sf_dir, "embeddings").withColumn("channel_idx", F.explode(F.sequence(F.lit(0), F.lit(6)))) \
        .withColumn("epoch", (F.col("vec_id") - F.col("channel_idx")).cast("int")).where("epoch >= 0")
    name = F.element_at(F.array(*map(F.lit, MONTAGE)), F.col("channel_idx") + 1)
    kind = F.col("epoch") % 5
    channel = F.when(kind == 3, F.lower(name)).when((kind == 4) & (name == "CPz"), F.lit("Oz")).otherwise(name)
    return e.select(*[c.alias(n) for n, c in _owner(F.col("epoch")).items()], "epoch", "channel_idx",
                    channel.alias("channel"), F.lit(RATE).alias("sfreq"), F.lit(T0).alias("t0"), F.lit(N).alias("n_times"),
                    F.col("embedding").cast("array<double>").alias("signal"))


MONTAGE_SQL = f"""mont0 AS (SELECT (vec_id - o)::INT AS epoch, o::INT AS channel_idx,
    {MONTAGE!r}[o + 1] AS name, embedding::DOUBLE[] AS s FROM embeddings, range(0, 7) r(o) WHERE vec_id - o >= 0),
mont AS (SELECT {OWNER_SQL.format(e='epoch')}, epoch, channel_idx,
    CASE WHEN epoch % 5 = 3 THEN lower(name) WHEN epoch % 5 = 4 AND name = 'CPz' THEN 'Oz' ELSE name END AS channel, s
    FROM mont0)"""


# The lines of an order are its events, told apart by part and price.
EVENT_POS = "l_partkey * 100000000 + cast(round(l_extendedprice * 100) AS bigint)"
EVENT_POS_SQL = "l_partkey * 100000000 + round(l_extendedprice * 100)::BIGINT"


def epoch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label events for those epochs, numbers already: order k labels the epoch that counts k + 1 from 1."""
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        *[c.alias(n) for n, c in _owner(k).items()], F.expr(EVENT_POS).alias("event_pos"),
        (k + 1).cast("int").alias("epoch"), (F.col("l_discount") * 100).alias("rating"), F.col("l_quantity").alias("laser_power"))


EPOCH_LABELS_SQL = f"""lab0 AS (SELECT {OWNER_SQL.format(e='l_orderkey')}, l_orderkey AS epoch, {EVENT_POS_SQL} AS event_pos,
    l_discount * 100 AS rating, l_quantity AS laser_power FROM lineitem),
lab AS (SELECT * FROM lab0 QUALIFY row_number() OVER (PARTITION BY dataset, subject, epoch
    ORDER BY event_pos, rating, laser_power) = 1)"""


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour labels as text, with texts that are not numbers and events without an epoch."""
    tax = F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.concat(F.lit("sub-"), F.col("l_orderkey").cast("string")).alias("subject"),
        F.expr(EVENT_POS).alias("event_pos"), F.col("l_linestatus").alias("type"),
        F.when(tax != 0.05, F.col("l_linenumber").cast("string")).alias("epoch"),
        F.when(tax == 0.08, "[]").when(tax == 0.07, "nan")
        .otherwise(F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("rating"),
        F.when(tax == 0.06, "n/a").otherwise((F.col("l_quantity") / 10).cast("string")).alias("laser_power"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_source.coerce(raw_labels(spark, sf_dir))


LABELS_SQL = f"""lb AS (SELECT l_returnflag AS dataset, 'sub-' || l_orderkey AS subject, {EVENT_POS_SQL} AS event_pos,
    l_linestatus AS type, CASE WHEN l_tax <> 0.05 THEN l_linenumber END AS epoch,
    CASE WHEN l_tax NOT IN (0.07, 0.08) THEN round(l_discount * 100) END AS rating,
    CASE WHEN l_tax <> 0.06 THEN l_quantity / 10 END AS laser_power FROM lineitem)"""


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as participants of the region's dataset; one region gives no ages."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("c_name").alias("participant_id"), F.col("r_name").alias("dataset"),
                         F.col("c_mktsegment").alias("Gender"),
                         F.when(F.col("r_name") != "ASIA", F.col("c_acctbal")).alias("Age"))


PARTICIPANTS_SQL = """pt AS (SELECT c_name AS participant_id, r_name AS dataset, c_mktsegment AS "Gender",
    CASE WHEN r_name <> 'ASIA' THEN c_acctbal END AS "Age" FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SEXES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]  # and one that the list lacks


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stored times have no zone: seconds since 1970 read in the same zone do not depend on the session's.
    start = F.unix_micros(F.expr("timestamp_ntz'1970-01-01 00:00:00'").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("event_type").alias("dataset"), F.concat(F.lit("sub-"), F.col("user_id").cast("string")).alias("subject"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 1e6).alias("onset"), F.col("value"), F.col("props"))


def manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object keys made from page addresses: the kind of file follows the page number, the dataset its language."""
    p = table(spark, sf_dir, "pages")
    lang = F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1)
    num = F.regexp_extract("url", "/([0-9]+)", 1)
    ds, sub = F.concat(F.lit("ds"), lang), F.concat(F.lit("sub-"), num)
    kind = F.col("page_id") % 10
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    folder = F.when(lang == "de", part(ds, "/", sub, "/eeg/")).otherwise(part(ds, "/derivatives/rerefer/"))
    page = F.col("page_id").cast("string")
    keys = F.when(kind == 0, F.array(part(ds, "/participants.tsv"))) \
        .when(kind == 1, F.array(part(ds, "/", sub, "/eeg/", sub, "_", page, "_events.tsv"))) \
        .when(kind == 2, F.array(part(ds, "/", sub, "/eeg/", sub, "_", page, "_events.json"))) \
        .when(kind == 3, F.array(part(ds, "/", sub, "/beh/", sub, "_", page, "_Beh.tsv"))) \
        .when(kind == 4, F.array(part(folder, sub, "_", page, ".set"), part(folder, sub, "_", page, ".fdt"))) \
        .when(kind == 5, F.array(part(folder, sub, "_", page, ".set"))) \
        .when(kind == 6, F.array(part(ds, "/README_", page))) \
        .when(kind == 7, F.array(F.when(lang == "de", part(folder, "x_", page, ".set"))
                                 .otherwise(part(ds, "/derivatives/mark_ica/", sub, "_", page, ".set")))) \
        .when(kind == 8, F.array(part(ds, "/", sub, "/eeg/", sub, "_", page, ".vhdr"))) \
        .otherwise(F.array(part(ds, "/derivatives")))
    return p.select(F.explode(keys).alias("key"), F.length("html").cast("bigint").alias("size"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.with_key_parts(manifest_keys(spark, sf_dir))


MANIFEST_SQL = r"""mf0 AS (SELECT page_id % 10 AS kind, page_id, length(html) AS size, regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS lang,
    'ds' || regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS ds, 'sub-' || regexp_extract(url, '/([0-9]+)', 1) AS sub FROM pages),
mf1 AS (SELECT *, CASE WHEN lang = 'de' THEN ds || '/' || sub || '/eeg/' ELSE ds || '/derivatives/rerefer/' END AS folder FROM mf0),
mf2 AS (SELECT size, unnest(CASE kind WHEN 0 THEN [ds || '/participants.tsv']
    WHEN 1 THEN [ds || '/' || sub || '/eeg/' || sub || '_' || page_id || '_events.tsv']
    WHEN 2 THEN [ds || '/' || sub || '/eeg/' || sub || '_' || page_id || '_events.json']
    WHEN 3 THEN [ds || '/' || sub || '/beh/' || sub || '_' || page_id || '_Beh.tsv']
    WHEN 4 THEN [folder || sub || '_' || page_id || '.set', folder || sub || '_' || page_id || '.fdt']
    WHEN 5 THEN [folder || sub || '_' || page_id || '.set']
    WHEN 6 THEN [ds || '/README_' || page_id]
    WHEN 7 THEN [CASE WHEN lang = 'de' THEN folder || 'x_' || page_id || '.set'
        ELSE ds || '/derivatives/mark_ica/' || sub || '_' || page_id || '.set' END]
    WHEN 8 THEN [ds || '/' || sub || '/eeg/' || sub || '_' || page_id || '.vhdr']
    ELSE [ds || '/derivatives'] END) AS key FROM mf1),
mf AS (SELECT key, size, split_part(key, '/', 1) AS dataset,
    coalesce(nullif(regexp_extract(key, '(sub-[A-Za-z0-9]+)', 1), ''), 'unknown') AS subject,
    CASE WHEN list_contains(string_split(key, '/'), 'derivatives')
        THEN coalesce(string_split(key, '/')[list_position(string_split(key, '/'), 'derivatives') + 1], 'unknown')
        ELSE 'unknown' END AS derivative,
    string_split(key, '/')[-1] AS basename, regexp_replace(key, '\.[^./]*$', '') AS stem,
    regexp_extract(key, '(\.[^./]*)$', 1) AS ext FROM mf2)"""


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (mostly not JSON) and event properties (JSON, much repeated) as sidecar texts."""
    d = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("_events.json")).alias("key"),
        F.col("source").alias("dataset"), F.col("text").alias("content"))
    e = table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("/e"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit("_events.json")).alias("key"),
        F.col("event_type").alias("dataset"), F.col("props").alias("content"))
    return d.unionAll(e)


SIDECARS_SQL = """sc AS (SELECT source || '/d' || lpad(doc_id::VARCHAR, 9, '0') || '_events.json' AS key, source AS dataset,
    text AS content FROM documents UNION ALL
    SELECT event_type || '/e' || lpad(event_id::VARCHAR, 9, '0') || '_events.json', event_type, props FROM events)"""

FEATURES = [f"f{i}" for i in range(1, 23)]


def matrix(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    """A model table: 22 vector elements (large ones missing), rating and laser power as targets."""
    x = F.col("embedding").cast("array<double>")
    cell = lambda i: F.get(x, F.lit(i))
    cells = {f: F.when(cell(i) <= 0.2, cell(i)) if gaps else cell(i) for i, f in enumerate(FEATURES)}
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("ds"), (F.col("vec_id") % 3).cast("string")).alias("dataset"), F.col("vec_id").alias("epoch"),
        *[c.alias(f) for f, c in cells.items()],
        F.col("label").cast("double").alias("rating"),
        F.when(F.col("label") != 9, cell(0) * 3 + cell(1) + cell(2)).alias("laser_power"))


MATRIX_SQL = "mx AS (SELECT 'ds' || (vec_id % 3) AS dataset, vec_id AS epoch, " + ", ".join(
    f"CASE WHEN embedding[{i + 1}]::DOUBLE <= 0.2 THEN embedding[{i + 1}]::DOUBLE END AS {f}" for i, f in enumerate(FEATURES)) + \
    ", label::DOUBLE AS rating, CASE WHEN label <> 9 THEN embedding[1]::DOUBLE * 3 + embedding[2]::DOUBLE + " \
    "embedding[3]::DOUBLE END AS laser_power FROM embeddings)"


def float_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector packed as one float32 block of 4 channels x 4 samples x 4 epochs; label 9 gets a wrong shape, label 8 none."""
    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        flat = np.asarray(values.flatten(), dtype="<f4").reshape(len(values), -1)
        return pa.array([row.tobytes() for row in flat], type=pa.binary())

    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("b/"), F.col("vec_id").cast("string")).alias("path"), pack("embedding").alias("content"),
                    F.when(F.col("label") != 8, 4).alias("nbchan"), F.lit(4).alias("pnts"),
                    F.when(F.col("label") == 9, 3).otherwise(4).alias("trials")) \
        .withColumn("length", F.length("content").cast("bigint"))


def block_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Files of 16 or of 4 vectors, each an epoch of 4 channels x 16 samples, written by the tasks; their shapes and the folder. Of the
    long files every fifth is said to hold an epoch more than it does."""
    folder, part = scratch_path(spark, "blocks"), F.expr("vec_id div 16")
    name = F.when(part % 2 == 0, F.concat(F.lit("L"), part)).otherwise(F.concat(F.lit("S"), F.expr("vec_id div 4")))
    vectors = table(spark, sf_dir, "embeddings").groupBy(name.alias("name"), (part % 10 == 4).alias("bad")) \
        .agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))

    def write(batches):
        for batch in batches:
            for stem, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = store_of(folder)
                store.create_dir(place, recursive=True)
                with store.open_output_stream(f"{place}/{stem}.fdt") as out:
                    out.write(np.array(rows, "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) for x in batch.column(1)], pa.int32())],
                                             ["name", "bad", "trials"])

    made = pin(vectors.select("name", F.col("v.embedding").alias("v"), "bad").mapInArrow(write, "name string, bad boolean, trials int"))
    prefix = folder if ":" in folder else "file:" + folder
    return made.select(F.concat(F.lit(prefix + "/"), "name", F.lit(".fdt")).alias("path"), F.lit(4).alias("nbchan"), F.lit(16).alias("pnts"),
                       (F.col("trials") + F.col("bad").cast("int")).alias("trials")), folder


PER_FILE = 8  # epochs of a stored file


def stored_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, headers and blocks: file b holds the montage epochs 8b .. 8b + 7; of ten files four are sound blocks, one holds its data
    itself with channels and samples swapped, and five lack something. A subject has several files.

    The files are gathered once, and their signals are stored before they are turned: an expression that reads them cell by cell would
    make the whole array anew for each cell, in every plan that reads the files.
    """
    rows = montage(spark, sf_dir).select(F.expr(f"epoch div {PER_FILE}").alias("b"), F.struct(
        (F.col("epoch") % PER_FILE).alias("k"), "channel_idx", F.col("signal").cast("array<float>").alias("v")).alias("cell"))
    files = rows.groupBy("b").agg(F.array_sort(F.collect_list("cell")).alias("cells")).where(F.size("cells") == 7 * PER_FILE)

    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        cubes = np.asarray(values.flatten(), dtype="<f4").reshape(len(values), PER_FILE, 7, N).transpose(0, 1, 3, 2)
        return pa.array([c.tobytes() for c in cubes], type=pa.binary())

    b, kind, name = F.col("b"), F.col("b") % 10, F.lit(MONTAGE)
    files = pin(files.select("b", F.flatten("cells.v").alias("flat"), F.concat(
        F.lit("ds00"), (b % 5 + 1).cast("string"), F.lit("/derivatives/rerefer/sub-"), (b % 20).cast("string"), F.lit("_f"), b.cast("string")).alias("stem")))
    key = F.concat("stem", F.lit(".set"))
    names = F.when(b % 20 == 3, F.transform(name, lambda c: F.concat(F.lit("x"), c))).when(b % 5 == 3, F.transform(name, lambda c: F.lower(c))) \
        .when(kind == 9, F.slice(name, 1, 6)).when(b % 5 == 4, F.array(*[F.lit("Oz" if c == "CPz" else c) for c in MONTAGE])).otherwise(name)
    # Swapped: epoch, sample, channel.
    turned = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PER_FILE * N - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda c: F.get("flat", (F.floor(i / N) * 7 + c) * N + i % N))))
    headers = pin(files.select(
        key.alias("key"), F.when(kind != 7, 7).alias("nbchan"), F.lit(N).alias("pnts"), F.when(kind == 6, 9).otherwise(PER_FILE).alias("trials"),
        F.lit(RATE).alias("srate"), F.when(kind != 5, T0).alias("xmin"), names.alias("channels"),
        F.when(kind == 2, turned.cast("array<double>")).alias("data"), F.when(kind == 2, F.array(F.lit(PER_FILE), F.lit(N), F.lit(7))).alias("dims")))
    blocks = files.where(~kind.isin(2, 8)).select(F.concat("stem", F.lit(".fdt")).alias("key"), pack("flat").alias("content"))
    keys = files.select(key.alias("key"), F.lit(1).cast("bigint").alias("size")).union(
        blocks.select("key", F.length("content").cast("bigint"))).union(files.select(F.concat(F.replace("stem", F.lit("rerefer"), F.lit("raw")), F.lit(".set")), F.lit(1)))
    return objects.with_key_parts(keys), headers, blocks


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label events of the stored files, each in its own file."""
    k = F.col("l_orderkey")
    b = F.expr(f"l_orderkey div {PER_FILE}")
    owner = {"dataset": F.concat(F.lit("ds00"), (b % 5 + 1).cast("string")), "subject": F.concat(F.lit("sub-"), (b % 20).cast("string"))}
    file = F.concat("dataset", F.lit("/derivatives/rerefer/"), "subject", F.lit("_f"), b.cast("string"), F.lit(".set"))
    return table(spark, sf_dir, "lineitem").withColumns(owner).select(
        "dataset", "subject", file.alias("file"), F.expr(EVENT_POS).alias("event_pos"), (k % PER_FILE + 1).cast("int").alias("epoch"),
        (F.col("l_discount") * 100).alias("rating"), F.col("l_quantity").alias("laser_power"))


FILES_SQL = f"""fb AS (SELECT b, 'ds00' || (b % 5 + 1) AS dataset, 'sub-' || (b % 20) AS subject,
    'ds00' || (b % 5 + 1) || '/derivatives/rerefer/sub-' || (b % 20) || '_f' || b || '.set' AS file, CASE WHEN b % 10 = 8 THEN 'block'
    WHEN b % 10 = 7 THEN 'block shape' WHEN b % 10 = 6 THEN 'block size' WHEN b % 10 = 9 THEN 'shape' WHEN b % 10 = 5 THEN 'times'
    WHEN b % 20 = 3 THEN 'channels' END AS stage, CASE WHEN b % 10 = 8 THEN 'no signal data' WHEN b % 10 = 7 THEN 'no channel or sample count'
    WHEN b % 10 = 6 THEN '14336 bytes for 7 x 64 x 9 values of 4' WHEN b % 10 = 9 THEN 'channel count differs from names' WHEN b % 10 = 5 THEN 'no time axis'
    WHEN b % 20 = 3 THEN 'no vertex channel' END AS reason FROM range(0, (SELECT (max(vec_id) - 5) // {PER_FILE} FROM embeddings)) r(b))"""
