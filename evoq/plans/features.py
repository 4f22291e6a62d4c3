"""The feature table: one wide row per epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoq.config import SignalSpec, epoch_key
from evoq.functions.arrays import without_helpers
from evoq.operators import channels, complexity, erp, phase, spectral, trials
from evoq.sources import signals

ERP = ["n2_amp", "n2_lat", "p2_amp", "p2_lat", "n2p2_amp"]
SPECTRAL = ["gamma_power", "gamma_band_hz", "alpha_erd_pct", "beta_erd_pct"]
COMPLEXITY = ["perm_entropy", "spectral_entropy", "sample_entropy", "higuchi_fd", "dfa",
              "hjorth_mobility", "hjorth_complexity"]


def feature_columns(spec: SignalSpec = SignalSpec()) -> list[str]:
    return ERP + SPECTRAL + [f"psd_{b}" for b in spec.bands] + [f"plv_{a}-{b}" for a, b in spec.pairs] + COMPLEXITY


def row_features(vertex: DataFrame, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """All features that need only the epoch's own row: no shuffle, one visit to Python for all kernels."""
    out = erp.with_windows(vertex, spec)
    out = erp.with_peaks(out, spec)
    out = spectral.with_gamma(out, spec)
    out = spectral.with_erd(out, spec)
    out = spectral.with_psd(out, spec)
    out = spectral.with_band_powers(out, spec)
    out = spectral.with_spectral_entropy(out, spec)
    out = complexity.with_sample_entropy(out, spec)
    out = complexity.with_dfa(out, spec)
    return without_helpers(out.drop("signal"))


def feature_table(epochs: DataFrame, labels: DataFrame | None = None, spec: SignalSpec = SignalSpec()) -> DataFrame:
    """Features of every epoch whose file has a vertex channel, with rating and laser power where labelled.

    Where the epochs have a ``file``, it is part of the key, so that the files of one subject stay apart; labels then need it as well,
    or they go to all files of their subject.

    Three short-row tables keyed alike (row features, neighbour features, phase locking) meet in joins on the epoch
    key; signals themselves are never shuffled for them, save the phasors of the pairs' channels.
    """
    vertex = channels.vertex_epochs(epochs, spec.vertex_priority)
    key = epoch_key(epochs)
    table = row_features(vertex, spec) \
        .join(complexity.neighbour_features(vertex, spec), key, "left") \
        .join(phase.phase_locking(epochs, spec), key, "left")
    if labels is None:
        table = table.withColumns({"rating": F.lit(None).cast("double"), "laser_power": F.lit(None).cast("double")})
    else:
        table = trials.attach_labels(table, labels)
    names = [*key, "vertex_channel", "sfreq", *feature_columns(spec), "rating", "laser_power"]
    return table.select(*[F.col(f"`{n}`") for n in names])


def extract(epochs: DataFrame, files: DataFrame, labels: DataFrame | None = None,
            spec: SignalSpec = SignalSpec()) -> tuple[DataFrame, DataFrame]:
    """All datasets in one plan: good files to the feature table, bad ones to rejects with a reason each."""
    good, rejects = signals.check_shapes(epochs, files)
    listed = channels.channel_table(good)
    without = listed.select("dataset", "subject").distinct() \
        .join(channels.pick_vertex(listed, spec.vertex_priority), ["dataset", "subject"], "left_anti") \
        .select("dataset", "subject", F.lit("no vertex channel").alias("reason"), F.lit("channels").alias("stage"))
    return feature_table(good, labels, spec), rejects.unionByName(without)


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("dataset", "reason").agg(F.count(F.lit(1)).alias("n"))
