"""Reports: each is a set of named tables; ``as_long`` stacks their figures into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoq.functions.text import guess_column
from evoq.operators import summaries
from evoq.operators.ranking import first_per_group
from evoq.session import pin
from evoq.sources import manifest as objects
from evoq.sources import sidecars as jsons


def as_long(sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``section, group, metric, value`` of tables given with their key columns."""
    frames = []
    for name, (table, keys) in sections.items():
        values = [c for c in table.columns if c not in keys]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"))
                          for c in values])
        group = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
        frames.append(table.select(F.lit(name).alias("section"), group.alias("group"), F.inline(cells)))
    return reduce(lambda a, b: a.unionAll(b), frames)


def demographics(participants: DataFrame, sexes: list[str], age_bins: int = 15) -> dict[str, tuple[DataFrame, list[str]]]:
    """Participants, age summary and histogram, sex counts, per dataset; parts without a column are left out."""
    age = guess_column(participants.columns, ["age"])
    sex = guess_column(participants.columns, ["sex", "gender"])
    out = {"n_subjects": (summaries.group_count(participants, ["dataset"], "n_subjects"), ["dataset"])}
    if age:
        out["age"] = (summaries.describe(participants, ["dataset"], age), ["dataset"])
        out["age_histogram"] = (summaries.equal_width_histogram(participants, "dataset", age, age_bins)
                                .select("dataset", "bin", "n"), ["dataset", "bin"])
    if sex:
        out["sex"] = (summaries.crosstab(participants, "dataset", sex, sexes), ["dataset"])
    return out


def behaviour(labels: DataFrame, power_bins: int = 20) -> dict[str, tuple[DataFrame, list[str]]]:
    """Trials per subject, rating and power histograms, correlation, per dataset. ``labels`` are coerced.

    The few label columns are written once and read by every part, so that the source is decoded once.
    """
    # The words that tell the columns.
    rating = guess_column(labels.columns, ["rating", "pain", "nrs"], exact="rating")
    power = guess_column(labels.columns, ["intensity", "energy", "power", "joule"], exact="laser_power")
    labels = pin(labels.select("dataset", "subject", *[c for c in (rating, power) if c]))
    trials = pin(summaries.trials_per_subject(labels))
    out = {"trials": (summaries.describe(trials, ["dataset"], "n_trials"), ["dataset"]),
           "trials_box": (summaries.box_stats(trials, "dataset", "n_trials"), ["dataset"])}
    if rating:
        out["rating_histogram"] = (summaries.unit_histogram(labels, "dataset", rating), ["dataset", "bin"])
    if power:
        out["power_histogram"] = (summaries.equal_width_histogram(labels, "dataset", power, power_bins)
                                  .select("dataset", "bin", "n", "density"), ["dataset", "bin"])
    if rating and power:
        out["correlation"] = (summaries.pearson(labels, "dataset", power, rating), ["dataset"])
    return out


def zero_ratings(labels: DataFrame, top: int = 10) -> dict[str, tuple[DataFrame, list[str]]]:
    """Whether ratings of 0 look like placeholders: their share, epochs, laser power and count per subject."""
    labels = pin(labels.select("dataset", "subject", "epoch", "rating", "laser_power"))
    is_zero: Column = F.col("rating") == 0
    zeros = labels.where(is_zero)
    totals = labels.agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(is_zero).alias("n_zero"),
                        summaries.share_pct(is_zero).alias("zero_pct"))
    return {
        "totals": (totals, []),
        "epochs": (summaries.value_counts(zeros, "epoch").orderBy("epoch").limit(top), ["epoch"]),
        "at_minimum": (summaries.fraction_at_minimum(zeros, "epoch"), []),
        "power_of_zeros": (summaries.describe(zeros, [], "laser_power", full=True), []),
        "power_of_all": (summaries.describe(labels, [], "laser_power", full=True), []),
        "per_subject": (summaries.group_size_stats(zeros, ["dataset", "subject"]), []),
    }


def stored_files(manifest: DataFrame, sidecars: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a store holds: sidecars by content, behaviour files, derivatives present, datasets' file counts."""
    key = F.col("key")
    behaviour_files = manifest.where(objects.is_behaviour_file(key))
    out = {
        "behaviour_counts": summaries.group_count(behaviour_files, ["dataset"], "n_files"),
        "behaviour_examples": first_per_group(behaviour_files.select("dataset", "key"), ["dataset"], [key], 5),
        "derivatives": objects.by_derivative(objects.preferred_sets(manifest)),
        "sidecar_counts": summaries.group_count(manifest.where(key.endswith("_events.json")), ["dataset"], "n_files"),
    }
    if sidecars is not None:
        out["sidecars"] = jsons.first_contents(sidecars, 2)
    return out
