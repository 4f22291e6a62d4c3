"""The corpus pipeline: language, near copies, benchmark items, secrets, token ids, each stage over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evoq.llm import contamination, language, near_copies, queries, secrets, word_bpe
from evoq.session import pin, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with enough confidence; those without a letter go."""
    spec = language.LanguageSpec()
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit_language_model(docs, "doc_id", "text", "lang", ~F.coalesce(held_out, F.lit(False)), spec)
    return language.predict(docs.select(*COLUMNS), model, "text", spec).where("accepted").select(*COLUMNS)


PERCENT = 85  # two texts that share so much of their shingles are near copies


def row_key() -> Column:
    """128 bits that tell rows of different id or text apart, as doc_id may be null or repeated. It is made from the row itself, so it is
    the same in every branch and after a lost task, and no copy of the rows is needed for it."""
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit("")))
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in ``gone`` (``row``), pinned before so that the planner knows its size."""
    return docs.withColumn("_row", row_key()).join(pin(gone.select(F.col("row").alias("_row"))), "_row", "left_anti").select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (``PERCENT``): that of the least doc_id; one without an id only if none of its
    group has one. Rows that repeat id and text are one, whatever the text."""
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_key().alias("row"))
    groups = pin(near_copies.near_copies(docs.select(own.alias("own"), "text"), "own", "text", near_copies.NearSpec(percent=PERCENT)))
    # Rows without a word are linked with nothing; of those that repeat an id, the one of the least key stays.
    blank = groups.where("n_shingles = 0 and not key.no_id")
    first = blank.groupBy("key.doc_id").agg(F.min("key.row").alias("first"))
    again = blank.join(first, F.col("key.doc_id") == first["doc_id"]).where("key.row <> first").select("key.row")
    gone = groups.where(~F.col("kept")).select("key.row").union(again)
    # Rows repeated as they are have one key and are kept alike: only they, few or many, are brought together.
    often = pin(groups.where("kept and not (n_shingles = 0 and key.no_id)").groupBy("key.row").count().where("count > 1").select("row"))
    repeated = docs.withColumn("_row", row_key()).join(often, F.col("_row") == F.col("row"), "left_semi").dropDuplicates(["_row"])
    return without(docs, gone.union(often).distinct()).unionByName(repeated.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    items = queries.table(spark, sf_dir, "benchmark")
    found = contamination.contaminated(docs.select(row_key().alias("row"), "text"), items, "row", "text", "item_id", "text", None)
    return without(docs, found.select(F.col("key").alias("row")).distinct())


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark and counts the characters of changed texts anew; keeps all documents."""
    rows = docs.select(*COLUMNS, row_key().alias("_row"), F.xxhash64("text").alias("_before"))
    done = secrets.redact_secrets(rows, "source", "doc_id", "_row", "text")
    changed = ~F.xxhash64("text").eqNullSafe(F.col("_before"))
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, as decimal numbers joined by spaces."""
    encoded = word_bpe.encode_texts(docs, queries.tokenizer_file("word_bpe_49k.json"), "doc_id", "text", decoded=False, part=0.25)
    return encoded.select(F.col("key").alias("doc_id"), "n_tokens", "ids")


STAGES = [("language_id", language_stage), ("near_dedup", near_copy_stage), ("benchmark_decontamination", benchmark_stage),
          ("secret_scan", secret_stage), ("bpe_encoding", token_stage)]

# SQL has no trained classifier and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written to the shared folder and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
