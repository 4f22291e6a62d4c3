"""Delimited tables: participants, raw events, feature tables; and the sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoq.functions import text
from evoq.functions.numbers import to_number
from evoq.session import pin

# Texts that stand for a missing value in the tab-separated files.
MISSING_TEXTS = ["", "n/a", "N/A", "NA", "nan", "NaN", "null", "NULL", "None"]

PARTICIPANTS = T.StructType([T.StructField(name, kind) for name, kind in [
    ("participant_id", T.StringType()), ("ID", T.IntegerType()), ("Pre_ID", T.IntegerType()),
    ("Gender", T.StringType()), ("Age", T.DoubleType()), ("Education", T.DoubleType()),
    ("Pain_Threshold_7", T.DoubleType()), ("dataset", T.StringType()), ("Dominant_hand", T.StringType()),
    ("laser_low", T.DoubleType()), ("laser_high", T.DoubleType()), ("TENS", T.DoubleType()),
    ("Group", T.DoubleType()), ("Energy", T.DoubleType()), ("Pain_Threthold", T.DoubleType()),
    ("Pain_Threshod", T.DoubleType())]])

RAW_EVENTS = "onset double, duration double, sample bigint, value string, extra map<string,string>, " \
             "subject string, dataset string, source_file string"


def blank_missing(df: DataFrame) -> DataFrame:
    """NULL in the place of the texts that mean missing, in every string column."""
    return df.select([
        F.when(~F.trim(F.col(f"`{f.name}`")).isin(MISSING_TEXTS), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give text columns the declared types; a bad value is NULL, an unknown column stays text."""
    kinds = {f.name: f.dataType for f in schema}
    return df.select([
        F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds and not isinstance(kinds[c], T.StringType)
        else F.col(f"`{c}`") for c in df.columns])


def union_all(spark: SparkSession, frames: list[DataFrame], schema: T.StructType | str) -> DataFrame:
    """Union by name; columns one side lacks are NULL there. No frame at all gives an empty one."""
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_participants(spark: SparkSession, path_of_dataset: dict[str, str]) -> DataFrame:
    """One table of all datasets; each file has its own columns. A missing file adds no rows."""
    frames = []
    for dataset, path in path_of_dataset.items():
        reader = spark.read.options(sep="\t", header=True, ignoreMissingFiles=True, encoding="UTF-8")
        try:
            found = typed(blank_missing(reader.csv(path)), PARTICIPANTS)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        frames.append(found.withColumn("dataset", F.lit(dataset)))
    return union_all(spark, frames, PARTICIPANTS)


def _places_beyond(names: str, cells: str) -> Column:
    """Names for the cells that a line has beyond the header."""
    more = F.transform(F.sequence(F.size(names), F.greatest(F.size(cells) - 1, F.size(names))), lambda i: F.concat(F.lit("_"), i))
    return F.when(F.size(cells) > F.size(names), more).otherwise(F.array().cast("array<string>"))


def _numbered(names: Column) -> Column:
    """A repeated name gets the number of its earlier occurrences."""
    def name(n: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda m: m == n))
        return F.when(before == 0, n).otherwise(F.concat(n, F.lit("."), before))
    return F.transform(names, name)


def read_event_files(spark: SparkSession, path: str, glob: str = "*_events.tsv") -> DataFrame:
    """One row per event of every ``*_events.tsv`` file, in one scan whatever columns each file has.

    A file is small, so it is read whole; its first line names the fields of the others. Fields without a
    column of their own are kept in ``extra``. Cells that a short line lacks are NULL; cells beyond the header are
    kept in ``extra`` under their place (``_5``); a name that the header repeats is numbered (``value``, ``value.1``).
    """
    # Folders are many and short, one task lists many of them; by default each has a task of its own.
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(4 * spark.sparkContext.defaultParallelism))
    try:
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)
    files = found.select(F.col("_metadata.file_path").alias("source_file"), "value")
    lines = files.select("source_file", F.split("value", "\r?\n").alias("lines")) \
        .select("source_file", F.split(F.get("lines", F.lit(0)), "\t").alias("names"),
                F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    fields = lines.where(F.trim("line") != "").withColumn("cells", F.split("line", "\t")) \
        .withColumn("names", _numbered(_numbered(F.concat("names", _places_beyond("names", "cells"))))) \
        .select("source_file", F.map_from_arrays("names", F.transform("names", lambda _, i: F.get("cells", i)))
                .alias("cell")) \
        .withColumn("cell", F.transform_values("cell", lambda _, c: F.when(~F.trim(c).isin(MISSING_TEXTS), c)))
    known = ["onset", "duration", "sample", "value"]
    cell = lambda name: F.try_element_at("cell", F.lit(name))
    return fields.select(
        to_number(cell("onset")).alias("onset"), to_number(cell("duration")).alias("duration"),
        cell("sample").try_cast("bigint").alias("sample"), cell("value").alias("value"),
        F.map_filter("cell", lambda k, v: ~k.isin(known)).alias("extra"),
        text.subject_of(F.col("source_file")).alias("subject"),
        F.regexp_extract("source_file", "(ds[0-9]+)/", 1).alias("dataset"), "source_file")


def read_features_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_parquet(df: DataFrame, path: str, by: str = "dataset") -> None:
    """One folder per dataset, so that reading one dataset reads nothing else."""
    df.write.partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """All rows, or one folder per value of ``by``, with header lines."""
    writer = df.write.option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_by(df: DataFrame, by: str, place: str, path: str, per_task: int = 100_000, per_file: int = 20_000) -> None:
    """Tab-separated files, a folder per value of ``by``, each written by one task, so there are as many files as values and not as many from
    each task. The rows of a value with more than ``per_task`` are dealt to several tasks by the number ``place``; no file has over ``per_file``."""
    many = pin(df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / per_task).alias("_pieces")).where("_pieces > 1"))
    dealt = df.join(many, by, "left").withColumn("_piece", F.coalesce(F.pmod(F.col(place), F.col("_pieces")), F.lit(0)))
    # Writing costs by files, not by bytes, so sizes in bytes must not decide how many tasks share it.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(width, by, "_piece").drop("_pieces", "_piece").write.partitionBy(by) \
        .options(sep="\t", header=True, nullValue="n/a", maxRecordsPerFile=per_file).csv(path)
