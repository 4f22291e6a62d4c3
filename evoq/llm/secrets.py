"""Credentials in sidecar texts, told apart by how many subjects and datasets hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.session import pin

# The three base kinds in their order (pattern, group that holds the value, fewest characters of the group).
BASE_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
# The added kind: a long token with a digit and a letter, kept only where its owners show it to be live.
LIVE = ("live", r"[A-Za-z0-9+/_-]{20,}", 0, 20)

SPAN = "array<struct<start: int, kind_no: int, kind: string, end: int, value: string>>"


def matches(text: Column, kind: str, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """Places of the leftmost, non-overlapping matches whose value has at least ``least`` characters.

    The pieces between the matches and the matches themselves give the places, in code points: a match starts after
    all pieces up to it and all matches before it.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    step = F.arrays_zip(pieces.alias("p"), found.alias("m"), values.alias("v"))
    none = F.expr(f"cast(array() as {SPAN})")
    walked = F.aggregate(step, F.struct(F.lit(0).alias("at"), none.alias("spans")), lambda acc, x: F.struct(
        (acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
        F.when(F.length(x["v"]) >= least, F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(x["p"])).alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"),
            (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"), x["v"].alias("value"))))).otherwise(acc["spans"]).alias("spans")))
    return F.when(F.rlike(text, F.lit(pattern)), walked["spans"]).otherwise(none)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_candidates(sidecars: DataFrame, content: str) -> DataFrame:
    """The rows with ``base``, the spans of the base kinds, and ``live``, the further long tokens outside them."""
    text = F.coalesce(F.col(content), F.lit(""))
    kinds = [matches(F.col("_text"), kind, i, pattern, group, least)
             for i, (kind, pattern, group, least) in enumerate((*BASE_KINDS, LIVE))]
    names = [n for n in sidecars.columns if n not in ("base", "live")]
    found = sidecars.select(*names, text.alias("_text")).select(*names, *[k.alias(f"_{i}") for i, k in enumerate(kinds)])
    base = F.array_sort(F.concat("_0", "_1", "_2"))
    outside = F.filter("_3", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.withColumn("base", base).withColumn("live", outside).select(*names, "base", "live")


def candidates(sidecars: DataFrame, dataset: str, subject: str, key: str, content: str) -> DataFrame:
    """``row, dataset, subject, key, base, live``: one row per text; no text is kept."""
    named = sidecars.select(F.col(dataset).alias("dataset"), F.col(subject).alias("subject"), F.col(key).alias("key"), F.col(content).alias("content"))
    return with_candidates(named, "content").select("dataset", "subject", "key", "base", "live").withColumn("row", F.monotonically_increasing_id())


def ownership(spans: DataFrame) -> DataFrame:
    """``digest, n_subjects, n_datasets``: how many subjects of how many datasets hold each value."""
    holders = spans.groupBy("digest", "dataset", "subject").agg(F.lit(1).alias("one"))
    by_dataset = holders.groupBy("digest", "dataset").agg(F.count("subject").alias("n"))
    return by_dataset.groupBy("digest").agg(F.sum("n").alias("n_subjects"), F.count("dataset").alias("n_datasets"))


def scan_secrets(sidecars: DataFrame, dataset: str = "dataset", subject: str = "subject", key: str = "key",
                 content: str = "content", copied_from: int = 3) -> DataFrame:
    """One row per sidecar text: ``key, base, spans, n_live, n_copied``.

    ``base`` holds the spans (``start, kind_no, kind, end, value``; code points, end exclusive) of the kinds assign, access and hex.
    The corpus decides about further long tokens: every value is hashed and its distinct datasets (owners) and subjects
    (an owner's repositories) are counted. A token outside the base spans held by one dataset and fewer than
    ``copied_from`` of its subjects looks live and joins ``spans`` as kind live. ``n_live`` and ``n_copied`` count the
    spans whose value is owner-specific or widely copied by the same rule. Only column functions are used.

    * A null text is empty and gives no span; a null dataset or subject counts as no owner of its own.
    * Every row, repeated ones included, gives one row; an empty table an empty one. Other columns are ignored.
    """
    rows = pin(candidates(sidecars, dataset, subject, key, content))
    every = F.concat(F.transform("base", lambda s: F.struct(s.alias("span"), F.lit(True).alias("is_base"))),
                     F.transform("live", lambda s: F.struct(s.alias("span"), F.lit(False).alias("is_base"))))
    spans = pin(rows.where((F.size("base") > 0) | (F.size("live") > 0)).select("row", "dataset", "subject", F.explode(every).alias("s"))
                .select("row", "dataset", "subject", "s.span", "s.is_base", F.sha2("s.span.value", 256).alias("digest")))
    judged = spans.select("row", "span", "is_base", "digest").join(ownership(spans), "digest") \
        .withColumn("specific", (F.col("n_datasets") <= 1) & (F.col("n_subjects") < copied_from)) \
        .where("is_base or specific").groupBy("row").agg(
            F.array_sort(F.collect_list("span")).alias("spans"), F.count_if("specific").alias("n_live"),
            F.count_if(~F.col("specific")).alias("n_copied"))
    return rows.select("row", "key", "base").join(judged, "row", "left").select(
        "key", "base", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones joined, replaced by a mark; null without a text."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    walked = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"])
        .otherwise(F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out")))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(walked["out"], text.substr(walked["at"] + 1, F.length(text))))


def redact_secrets(sidecars: DataFrame, dataset: str = "dataset", subject: str = "subject", key: str = "key", content: str = "content",
                   copied_from: int = 3) -> DataFrame:
    """The rows, all columns kept, with every secret of ``scan_secrets`` in ``content`` replaced by a mark.

    ``key`` must tell rows of different text apart; rows that repeat key and text get the same text. Spans of the base kinds are
    redacted where the row is read. Only rows with a further long token wait for the answer of the corpus, and only they are
    joined; if the keys of live ones are too many to be broadcast, those rows alone are shuffled.
    """
    marked = with_candidates(sidecars, content)
    found = scan_secrets(sidecars, dataset, subject, key, content, copied_from).where(F.exists("spans", lambda s: s["kind"] == LIVE[0]))
    live = pin(found.groupBy(F.col("key").alias("_key")).agg(F.first("spans").alias("_spans")))
    some = F.size("live") > 0
    redacted = redact(F.col(content), F.coalesce("_spans", "base"))
    held = marked.where(some).join(live, F.col(key).eqNullSafe(F.col("_key")), "left")
    rows = held.unionByName(marked.where(~some).withColumn("_spans", F.lit(None).cast(SPAN)), allowMissingColumns=True)
    return rows.withColumn(content, redacted).select(*sidecars.columns)
