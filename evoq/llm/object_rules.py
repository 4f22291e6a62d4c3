"""Allow or block stored objects by URL: fixed rules first, then association rules mined with FP-growth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.session import pin

ALLOW, BLOCK = "allow", "block"
_VERDICT = "verdict="


@dataclass(frozen=True)
class RuleSpec:
    """``support`` and ``confidence`` prune the mined rules; without a matching rule the verdict is ``default``."""

    support: float = 0.01
    confidence: float = 0.8
    default: str = ALLOW


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest fitting rule ``(verdict, host, path)``; null if none fits.

    A rule fits its host and the subdomains of it, where the path starts with the rule's.
    """
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in rules]
    return F.reduce(F.array_compact(F.array(*fits)), F.lit(None).cast("struct<size: int, rule: string, verdict: string>"),
                    lambda best, x: F.when(best.isNull() | (x["size"] > best["size"]), x).otherwise(best)) if fits \
        else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, parts of the path and of what follows, each marked by its kind."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
    marked = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.coalesce(F.array_distinct(F.concat(
        marked("s:", F.array(scheme)), marked("h:", F.split(host, r"\.")), marked("p:", F.split(path, r"[/._-]+")),
        marked("q:", F.split(rest, r"[?#&]+")))), F.expr("cast(array() as array<string>)"))


def mined_rules(labelled: DataFrame, spec: RuleSpec) -> DataFrame:
    """``antecedent, verdict, confidence, support``: token combinations that imply a verdict.

    FP-growth finds the combinations; kept are rules that end in a verdict with the asked confidence and that no rule
    of fewer of the same tokens matches in confidence.
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items"))
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=spec.support, minConfidence=spec.confidence).fit(baskets)
    rules = pin(model.associationRules.where(F.col("consequent")[0].startswith(_VERDICT)).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(_VERDICT) + 1, 100).alias("verdict"),
        "confidence", "support").where(~F.exists("antecedent", lambda x: x.startswith(_VERDICT))))
    # A rule's shorter rivals each hold all its tokens but one or more; they are found through a token they share.
    short = rules.select(F.col("antecedent").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c")) \
        .withColumn("token", F.col("part")[0])
    beaten = rules.withColumn("token", F.explode("antecedent")).join(short, "token").where(
        (F.size("part") < F.size("antecedent")) & (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence"))
        & (F.size(F.array_except("part", "antecedent")) == 0)).select("antecedent", "verdict").distinct()
    return rules.join(beaten, ["antecedent", "verdict"], "left_anti")


def judged_by_rules(unlabelled: DataFrame, rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """``tokens, mined``: the best matching rule's verdict for every distinct token set.

    The inverted index lists each rule under its rarest token only, so a common token leads to few rules; a rule found
    there is checked against the whole set. Best: highest confidence, then support, then the longer, then the first.
    """
    frequency = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    wanted = rules.select(F.explode("antecedent").alias("token")).distinct().join(frequency, "token", "left")
    index = pin(rules.withColumn("token", F.explode("antecedent")).join(wanted, "token")
                .groupBy("antecedent", "verdict", "confidence", "support")
                .agg(F.min(F.struct("n", "token"))["token"].alias("token")))
    sets = unlabelled.select("tokens").distinct()
    order = F.struct("confidence", "support", F.size("antecedent").alias("size"), F.array_join("antecedent", " ").alias("text"), "verdict")
    return sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token") \
        .where(F.size(F.array_except("antecedent", "tokens")) == 0) \
        .groupBy("tokens").agg(F.max(order)["verdict"].alias("mined"))


def judge_objects(manifest: DataFrame, rules: list[tuple[str, str, str]], key: str = "key", url: str = "url",
                  spec: RuleSpec = RuleSpec()) -> DataFrame:
    """One row per object of the manifest: ``key, host, path, rule, verdict``.

    The longest fitting rule decides; its verdicts are also the labels from which FP-growth mines URL token combinations.
    Objects without a fitting rule take the verdict of the best mined rule that matches their tokens (the longest rule's
    own host is only one token among others), or the default. Only column functions and Spark's own FP-growth run.

    * A null url, or one without ``://``, has an empty host and path, no rule, and the default verdict unless a mined rule
      matches. Tied rules go to the one listed first.
    * Every row gives one row, repeated ones and null keys included; an empty table gives an empty one. Other columns
      are ignored.
    """
    parsed = manifest.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")) \
        .select("key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    placed = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)) \
        .select("key", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"),
                url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    placed = pin(placed)
    labelled, open_ones = placed.where("verdict is not null"), placed.where("verdict is null")
    mined = judged_by_rules(open_ones, mined_rules(labelled, spec), labelled)
    decided = open_ones.join(mined, "tokens", "left").select("key", "host", "path", "rule", F.coalesce("mined", F.lit(spec.default)).alias("verdict"))
    return labelled.select("key", "host", "path", "rule", "verdict").union(decided)
