"""Analysis settings: windows, bands, channel lists and the static tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Span = tuple[float, float]

# Fixed values of the analysis: windows in seconds with the stimulus at 0, bands in Hz.
WINDOWS: dict[str, Span] = {
    "baseline": (-0.30, -0.05),
    "n2": (0.15, 0.35),
    "p2": (0.30, 0.55),
    "gamma": (0.05, 0.35),
    "erd_task": (0.0, 0.60),
    "plv": (0.0, 0.50),
    "psd": (-0.30, 0.60),
}
BANDS: dict[str, Span] = {
    "delta": (1.0, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 13.0),
    "beta": (13.0, 30.0),
    "gamma": (30.0, 100.0),
}
VERTEX_PRIORITY = ("Cz", "CPz", "FCz", "Fz", "Pz")
PLV_PAIRS = (("Fz", "Cz"), ("Cz", "Pz"), ("C3", "C4"), ("FCz", "CPz"))

FILE = ("dataset", "subject")
KEY = (*FILE, "epoch")


def file_key(df: DataFrame) -> list[str]:
    """What names a recording: dataset and subject, and the file where the table has it (a subject may have several)."""
    return [*FILE, *(["file"] if "file" in df.columns else [])]


def epoch_key(df: DataFrame) -> list[str]:
    return [*file_key(df), "epoch"]


@dataclass(frozen=True)
class SignalSpec:
    """What to compute on an epoch. The defaults are those of the analysis; other sampling set-ups override."""

    windows: dict[str, Span] = field(default_factory=lambda: dict(WINDOWS))
    bands: dict[str, Span] = field(default_factory=lambda: dict(BANDS))
    vertex_priority: tuple[str, ...] = VERTEX_PRIORITY
    pairs: tuple[tuple[str, str], ...] = PLV_PAIRS
    plv_band: Span = (4.0, 30.0)
    filter_order: int = 4
    psd_segment: int = 256
    erd_segment: int = 128
    min_samples: int = 8
    nyquist_margin: float = 5.0
    higuchi_kmax: int = 10
    entropy_tolerance: float = 0.2
    dfa_sizes: tuple[int, ...] | None = None  # None: geometric from 4 to a tenth of the length, ratio 1.2


# Experiment, accession, participants, system, channels, Hz, stimulated hand.
DATASETS = [
    ("exp1_ds005284", "ds005284", 26, "Biosemi", 62, 1024.0, "left"),
    ("exp2_ds005285", "ds005285", 29, "ANT Neuro", 32, 1000.0, "left"),
    ("exp3_ds005289", "ds005289", 39, "Brain Products", 64, 1000.0, "left"),
    ("exp4_ds005286", "ds005286", 30, "ANT Neuro", 32, 1000.0, "right"),
    ("exp5_ds005291", "ds005291", 65, "ANT Neuro", 32, 1000.0, "right"),
    ("exp6_ds005293", "ds005293", 95, "Brain Products", 64, 1000.0, "both"),
    ("exp7_ds005292", "ds005292", 142, "Biosemi", 62, 1024.0, "left"),
    ("exp8_ds005280", "ds005280", 223, "Brain Products", 64, 1000.0, "left"),
    ("exp9_ds005473", "ds005473", 29, "Brain Products", 64, 1000.0, "left"),
]

# Feature, description, source.
FEATURE_INFO = [
    ("n2_amp", "N2 peak amplitude (uV), 150-350ms", "Zhang et al. 2020; classic LEP marker"),
    ("n2_lat", "N2 peak latency (s)", "A-delta fiber conduction timing"),
    ("p2_amp", "P2 peak amplitude (uV), 300-550ms", "Zhang et al. 2020; classic LEP marker"),
    ("p2_lat", "P2 peak latency (s)", "Zhang et al. 2020"),
    ("n2p2_amp", "N2-P2 peak-to-peak amplitude (uV)", "Most-cited single LEP pain-intensity marker"),
    ("alpha_erd_pct", "Alpha (8-13Hz) event-related desync, %", "Paper 1 Sec 4.1; Chouchou 2021 (artifact-robust)"),
    ("beta_erd_pct", "Beta (13-30Hz) event-related desync, %", "Paper 1 Sec 4.2; Misra 2017"),
    ("gamma_power", "Gamma (30-100Hz) band power, post-stim", "Paper 1 Sec 4.4; Zhang 2012 -- pain salience"),
    ("psd_delta", "Delta (1-4Hz) power, Welch PSD", "Chronic-pain cognitive/theta-adjacent marker"),
    ("psd_theta", "Theta (4-8Hz) power, Welch PSD", "Paper 1 Sec 4.3; Tiemann 2025 -- affective load"),
    ("psd_alpha", "Alpha power, Welch PSD", "Sarnthein 2006 -- resting-state chronic pain"),
    ("psd_beta", "Beta power, Welch PSD", "Simis 2022 -- chronic pain phenotypes"),
    ("psd_gamma", "Gamma power, Welch PSD", "Salehin 2017 -- top ML feature"),
    ("plv_Fz-Cz", "Single-trial phase-locking, Fz-Cz", "PMC13317760 -- phase > power for pain"),
    ("plv_Cz-Pz", "Single-trial phase-locking, Cz-Pz", "PMC13317760"),
    ("plv_C3-C4", "Single-trial phase-locking, C3-C4", "Interhemispheric / laterality check"),
    ("perm_entropy", "Permutation entropy", "Complexity marker, general EEG-ML feature"),
    ("spectral_entropy", "Spectral entropy", "Signal randomness/complexity"),
    ("sample_entropy", "Sample entropy", "Trial-to-trial variability; Klotz et al. 2025"),
    ("higuchi_fd", "Higuchi fractal dimension", "Signal complexity"),
    ("dfa", "Detrended fluctuation analysis exp.", "Long-range temporal correlation"),
    ("hjorth_mobility", "Hjorth mobility", "Mean signal frequency proxy"),
    ("hjorth_complexity", "Hjorth complexity", "Frequency-change proxy"),
]

# Columns of the feature table that are not model inputs.
NON_FEATURES = ("dataset", "subject", "file", "epoch", "vertex_channel", "sfreq", "gamma_band_hz",
                "alpha_erd_pct", "plv_FCz-CPz", "rating", "laser_power")


def datasets_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        DATASETS, "exp_label string, accession string, n_subjects int, system string, n_channels int, "
                  "sfreq double, hand string")


def feature_info_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURE_INFO, "feature string, description string, source string")


def priority_table(spark: SparkSession, names: tuple[str, ...] = VERTEX_PRIORITY) -> DataFrame:
    return spark.createDataFrame([(n.lower(), i) for i, n in enumerate(names)], "name string, priority int")


def pairs_table(spark: SparkSession, pairs=PLV_PAIRS) -> DataFrame:
    return spark.createDataFrame([(f"{a}-{b}", a.lower(), b.lower()) for a, b in pairs],
                                 "pair string, name_a string, name_b string")
