"""The manifest: one row per stored object, with the parts of its key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evoq.functions import text
from evoq.session import pin
from evoq.sources import stores

LABEL_DERIVATIVE = "rerefer"


def list_objects(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Keys (below ``root``) and sizes of all objects; the content column is never read.

    Spark's file sources leave out objects of zero bytes and names that start with ``.`` or ``_``; where these count,
    use ``list_all_objects`` or read the store's own inventory (``from_inventory``).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    found = reader.load(root).select("path", F.col("length").alias("size"))
    return found.select(F.element_at(F.split("path", "\\Q" + base + "\\E", 2), -1).alias("key"), "size")


def list_all_objects(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Keys (below ``root``) and sizes of all objects, hidden and empty ones too; a root that is not there has none.

    Prefixes are expanded level by level: every level is one job whose tasks (``tasks``, as many as shuffles have by default) list
    the prefixes found by the level before. Each level is pinned; no listing passes through the driver.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefixes, levels = spark.createDataFrame([("",)], "prefix string"), []
    while True:
        found = pin(prefixes.repartition(tasks, "prefix").mapInArrow(stores.children(root), "key string, size bigint, folder boolean"))
        levels.append(found.where("not folder").select("key", "size"))
        prefixes = found.where("folder").select(F.col("key").alias("prefix"))
        if prefixes.isEmpty():
            return reduce(DataFrame.unionAll, levels)


def from_inventory(inventory: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """Keys and sizes of a store's inventory table: every object, hidden and empty ones too; folder marks are none."""
    return inventory.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")) \
        .where(F.col("key").isNotNull() & ~F.col("key").endswith("/"))


def under_prefix(manifest: DataFrame, prefix: str) -> DataFrame:
    return manifest.where(F.col("key").startswith(prefix))


def with_key_parts(objects: DataFrame) -> DataFrame:
    """Accession, subject, derivative, basename, stem and suffix of each key."""
    key = F.col("key")
    return objects.withColumns({
        "dataset": F.split(key, "/")[0],
        "subject": text.subject_of(key),
        "derivative": text.derivative_of(key),
        "basename": text.basename_of(key),
        "stem": text.stem_of(key),
        "ext": text.suffix_of(key),
    })


def missing_datasets(datasets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Accessions without a single object. One row per dataset is left before the join, so no dataset's objects meet."""
    present = manifest.select(F.col("dataset").alias("_present")).distinct()
    return datasets.join(present, F.col("accession") == F.col("_present"), "left_anti")


def ends_with_any(key: Column, suffixes: list[str]) -> Column:
    matches = [key.endswith(s) for s in suffixes]
    found = matches[0]
    for m in matches[1:]:
        found = found | m
    return found


def is_behaviour_file(key: Column) -> Column:
    return F.lower(text.basename_of(key)).contains("beh")


def in_derivative(key: Column, name: str = LABEL_DERIVATIVE) -> Column:
    return key.contains(f"/derivatives/{name}/")


def signal_files(manifest: DataFrame, name: str = LABEL_DERIVATIVE) -> DataFrame:
    return manifest.where(in_derivative(F.col("key"), name) & F.col("key").endswith(".set"))


def preferred_sets(manifest: DataFrame) -> DataFrame:
    """Per dataset the ``.set`` files below a derivatives folder; all ``.set`` files where there are none.

    The flag is one row per dataset, joined back, so that a large dataset is never one window group.
    """
    sets = manifest.where(F.col("key").endswith(".set")) \
        .withColumn("is_derived", F.lower("key").contains("derivatives"))
    flags = pin(sets.groupBy("dataset").agg(F.max("is_derived").alias("has_derived")))
    return sets.join(flags, "dataset").where(F.col("is_derived") | ~F.col("has_derived")) \
        .drop("is_derived", "has_derived")


def by_derivative(sets: DataFrame) -> DataFrame:
    """Count and smallest key per dataset and derivative."""
    return sets.groupBy("dataset", "derivative").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("key").alias("first_key"))


def with_sibling(files: DataFrame, manifest: DataFrame, suffix: str, column: str) -> DataFrame:
    """Attach the key of the object of the same stem with another suffix, NULL if it does not exist."""
    others = manifest.where(F.col("key").endswith(suffix)).select("stem", F.col("key").alias(column)).distinct()
    return files.join(others, "stem", "left")


def having_sibling(files: DataFrame, manifest: DataFrame, suffix: str) -> DataFrame:
    others = manifest.where(F.col("key").endswith(suffix)).select("stem")
    return files.join(others, "stem", "left_semi")
