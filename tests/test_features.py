"""Features of known signals through Spark."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoq.config import KEY, SignalSpec
from evoq.functions import kernels
from evoq.operators import channels, complexity, erp, phase, spectral
from evoq.plans import features
from evoq.sources import signals

SCHEMA = "dataset string, subject string, epoch int, channel_idx int, channel string, sfreq double, t0 double, " \
         "n_times int, signal array<double>"
RNG = np.random.default_rng(7)


def frame(spark, signals_, rate=1000.0, t0=-0.5, channel="Cz", subject="sub-1"):
    rows = [("ds1", subject, e, 0, channel, rate, t0, len(s), [float(v) for v in s]) for e, s in enumerate(signals_)]
    return spark.createDataFrame(rows, SCHEMA)


def by_epoch(df):
    return {r["epoch"]: r for r in df.collect()}


def times(n=1501, rate=1000.0, t0=-0.5):
    return t0 + np.arange(n) / rate


def test_peaks_follow_numpy(spark):
    data = RNG.normal(size=(20, 1501))
    got, t = by_epoch(erp.with_peaks(frame(spark, data))), times()
    for e, x in enumerate(data):
        inside = lambda lo, hi: (t >= lo) & (t <= hi)
        y = x - x[inside(-0.30, -0.05)].mean()
        n2, p2 = inside(0.15, 0.35), inside(0.30, 0.55)
        assert got[e]["n2_amp"] == pytest.approx(y[n2].min(), rel=1e-9)
        assert got[e]["n2_lat"] == t[n2][np.argmin(y[n2])]
        assert got[e]["p2_amp"] == pytest.approx(y[p2].max(), rel=1e-9)
        assert got[e]["p2_lat"] == t[p2][np.argmax(y[p2])]
        assert got[e]["n2p2_amp"] == pytest.approx(y[p2].max() - y[n2].min(), rel=1e-9)


def test_peaks_of_equal_values_missing_samples_and_short_epochs(spark):
    flat = np.zeros(1501)
    hole = np.zeros(1501)
    hole[660] = np.nan  # inside the N2 window only
    got = by_epoch(erp.with_peaks(frame(spark, [flat, hole])))
    assert got[0]["n2_lat"] == pytest.approx(0.15) and got[0]["p2_lat"] == pytest.approx(0.30)
    assert got[1]["n2_amp"] is None and got[1]["n2_lat"] == pytest.approx(0.16) and got[1]["p2_amp"] == 0
    short = by_epoch(erp.with_peaks(frame(spark, [np.ones(700)])))  # ends at 0.199 s, before P2
    assert all(short[0][c] is None for c in features.ERP)


@pytest.mark.parametrize("rate", [1000.0, 1024.0])
def test_window_bounds_at_both_rates(spark, rate):
    spec = SignalSpec()
    n = int(1.5 * rate) + 1
    row = erp.with_windows(frame(spark, [np.zeros(n)], rate=rate), spec).first()
    t = times(n, rate)
    for name, (lo, hi) in spec.windows.items():
        mask = (t >= lo) & (t <= hi)
        assert row[f"_{name}_count"] == mask.sum()
        assert row[f"_{name}_first"] == np.argmax(mask)


def test_explicit_time_axis(spark):
    ms = [float(v) for v in range(-500, 1001)]
    data = frame(spark, [RNG.normal(size=1501)]).withColumn("times", F.array(*[F.lit(v / 1000.0) for v in ms]))
    row = erp.with_windows(data, SignalSpec(), "baseline").first()
    assert (row["_baseline_first"], row["_baseline_count"]) == (200, 251)


def test_band_resolution_at_both_rates(spark):
    """Short windows leave bands with no bin (NULL) or one bin (0)."""
    noise = [RNG.normal(size=1501)]
    a = spectral.with_erd(spectral.with_band_powers(frame(spark, noise))).first()
    assert [a[f"psd_{b}"] for b in ("delta", "theta", "alpha")] == [0.0, 0.0, 0.0]
    assert a["psd_beta"] > 0 and a["psd_gamma"] > 0 and a["alpha_erd_pct"] is None and a["beta_erd_pct"] is not None
    b = spectral.with_erd(spectral.with_band_powers(frame(spark, [RNG.normal(size=1537)], rate=1024.0))).first()
    assert b["psd_delta"] == 0.0 and b["psd_theta"] > 0 and b["psd_alpha"] > 0
    assert b["alpha_erd_pct"] is None and b["beta_erd_pct"] is not None


def test_sine_power_is_in_its_band(spark):
    x = 3 * np.sin(2 * np.pi * 20 * times())
    row = spectral.with_gamma(spectral.with_band_powers(frame(spark, [x]))).first()
    t = times()
    power = kernels.welch_power(x[(t >= -0.30) & (t <= 0.60)][None], 1000.0, 256)[0]
    freqs = np.arange(129) * 1000.0 / 256
    beta = (freqs >= 13) & (freqs <= 30)
    assert row["psd_beta"] == pytest.approx(np.trapezoid(power[beta], freqs[beta]), rel=1e-9)
    assert row["psd_beta"] == pytest.approx(4.5, rel=0.1)  # a sine of 3 holds a power of 4.5, the band's ends cut some
    assert row["psd_gamma"] < 0.01 * row["psd_beta"] and row["gamma_band_hz"] == "30.0-100.0"


def test_gamma_band_text_is_uncapped_for_a_short_window(spark):
    low = frame(spark, [np.ones(97)], rate=64.0)
    assert spectral.with_gamma(low).first()["gamma_band_hz"] == "30.0-27.0"
    short = frame(spark, [np.ones(35)], rate=64.0)  # 7 samples in the gamma window
    row = spectral.with_gamma(short).first()
    assert row["gamma_power"] is None and row["gamma_band_hz"] == "30.0-100.0"


def test_complexity_of_known_signals(spark):
    spec = SignalSpec(windows={**SignalSpec().windows, "psd": (0.0, 10.0)})
    line = np.arange(1000.0)
    sine = np.sin(2 * np.pi * np.arange(3000) / 100)
    flat = np.ones(500)
    rows = frame(spark, [line, sine, flat], t0=0.0)
    near = by_epoch(complexity.neighbour_features(rows, spec))
    assert near[0]["higuchi_fd"] == pytest.approx(1.0040, abs=5e-5)
    assert near[1]["higuchi_fd"] == pytest.approx(1.0091, abs=5e-5)
    assert near[0]["perm_entropy"] == pytest.approx(0, abs=1e-12)
    assert near[1]["hjorth_mobility"] == pytest.approx(2 * math.sin(math.pi / 100), rel=1e-3)
    assert near[2]["hjorth_mobility"] is None and near[2]["higuchi_fd"] is None
    own = by_epoch(complexity.with_dfa(complexity.with_sample_entropy(rows, spec), spec))
    assert own[1]["sample_entropy"] == pytest.approx(0.1633, abs=5e-5)
    assert own[1]["dfa"] == pytest.approx(1.5848, abs=5e-5)
    assert own[2]["sample_entropy"] is None and own[2]["dfa"] is None


def montage(spark, names, data):
    rows = [("ds1", "sub-1", 0, i, c, 1000.0, -0.5, len(x), [float(v) for v in x]) for i, (c, x) in enumerate(zip(names, data))]
    return spark.createDataFrame(rows, SCHEMA)


def test_phase_locking(spark):
    x, noise = np.sin(2 * np.pi * 11 * times()), RNG.normal(size=1501)
    got = phase.phase_locking(montage(spark, ["Fz", "cz", "PZ", "C3", "C4"], [x, 5 * x, noise, noise, -noise])).first()
    assert got["plv_Fz-Cz"] == pytest.approx(1, abs=1e-6)
    assert got["plv_C3-C4"] == pytest.approx(1, abs=1e-9)
    assert 0 < got["plv_Cz-Pz"] < 0.99
    assert got["plv_FCz-CPz"] is None


def test_phase_locking_of_short_epochs_and_equal_names(spark):
    x, y = np.sin(2 * np.pi * 11 * times()), RNG.normal(size=1501)
    twice = phase.phase_locking(montage(spark, ["Fz", "Fz", "Cz"], [y, x, x])).first()
    assert twice["plv_Fz-Cz"] == pytest.approx(1, abs=1e-9)  # the last of equal names counts
    assert phase.phase_locking(montage(spark, ["Fz", "Cz"], [x[:505], x[:505]])).first()["plv_Fz-Cz"] is None


def test_vertex_choice(spark):
    rows = [("ds1", "a", 0, "fz"), ("ds1", "a", 1, "Pz"), ("ds1", "b", 0, "O1"), ("ds1", "c", 0, "CZ"), ("ds1", "c", 1, "cz")]
    table = spark.createDataFrame(rows, "dataset string, subject string, channel_idx int, channel string")
    got = {r["subject"]: (r["channel_idx"], r["vertex_channel"]) for r in channels.pick_vertex(table).collect()}
    assert got == {"a": (0, "fz"), "c": (1, "cz")}


def test_offset_and_scale(spark):
    """Offsets change nothing; a factor scales peaks, its square scales powers, the rest stays."""
    base = RNG.normal(size=1501).cumsum()
    mix = [base, RNG.normal(size=1501).cumsum()]
    variants = {"same": lambda x: x, "offset": lambda x: x + 100, "scaled": lambda x: 3 * x}
    frames = [montage(spark, ["Cz", "Fz"], [f(m) for m in mix]).withColumn("subject", F.lit(n)) for n, f in variants.items()]
    table = frames[0].unionByName(frames[1]).unionByName(frames[2])
    got = {r["subject"]: r.asDict() for r in features.feature_table(table).collect()}
    assert len(got) == 3
    for name, value in got["same"].items():
        if name in KEY or isinstance(value, str) or value is None:
            continue
        factor = 3 if name.endswith("_amp") else 9 if name.startswith("psd_") or name == "gamma_power" else 1
        assert got["offset"][name] == pytest.approx(value, rel=1e-5, abs=1e-8), name
        assert got["scaled"][name] == pytest.approx(value * (factor if name != "sfreq" else 1), rel=1e-5, abs=1e-8), name


def test_feature_columns_are_fixed(spark):
    table = features.feature_table(montage(spark, ["Cz"], [RNG.normal(size=1501)]))
    assert len(table.columns) == 32
    row = table.first()
    assert row["plv_C3-C4"] is None and row["rating"] is None and row["n2_amp"] is not None


def test_stored_channels_are_skipped_by_the_scan(spark, tmp_path):
    path = str(tmp_path / "epochs")
    signals.write_epochs(montage(spark, ["Cz", "O1"], RNG.normal(size=(2, 1501))), path)
    wanted = channels.named(signals.read_epochs(spark, path), ["Cz", "Pz"])
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "In(channel_key, [cz,pz])" in plan
    assert [r["channel"] for r in wanted.collect()] == ["Cz"]


def test_signals_are_not_shuffled_for_row_features(spark, tmp_path):
    path = str(tmp_path / "epochs")
    signals.write_epochs(montage(spark, ["Cz", "Fz"], RNG.normal(size=(2, 1501))), path)
    rows = features.row_features(channels.vertex_epochs(signals.read_epochs(spark, path)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_bad_files_are_rejected_with_a_reason(spark):
    good = frame(spark, RNG.normal(size=(2, 1501)))
    blind = frame(spark, RNG.normal(size=(1, 1501)), channel="O1", subject="sub-2")
    short = frame(spark, RNG.normal(size=(1, 900)), subject="sub-3")
    files = spark.createDataFrame([("ds1", f"sub-{i}", 1, 1501, 3) for i in (1, 2, 3)],
                                  "dataset string, subject string, n_channels int, n_times int, ndim int")
    table, rejects = features.extract(good.unionByName(blind).unionByName(short), files)
    assert {(r["subject"], r["epoch"]) for r in table.collect()} == {("sub-1", 0), ("sub-1", 1)}
    assert {(r["subject"], r["reason"]) for r in rejects.collect()} == {
        ("sub-2", "no vertex channel"), ("sub-3", "sample count differs from time axis")}
