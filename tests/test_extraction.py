import numpy as np
import pytest
from pyspark.sql import functions as F

from evoq.config import SignalSpec
from evoq.operators import trials
from evoq.plans import extraction, features
from evoq.sources import manifest, signals

RNG = np.random.default_rng(4)
SPEC = SignalSpec()
NAMES, RATE, N = ["Cz", "Fz", "O1"], 250.0, 300
HEADER = "key string, nbchan int, pnts int, trials int, srate double, xmin double, times_ms array<double>, channels array<string>, " \
         "data array<double>, dims array<int>"


def key_of(name):
    return f"ds1/derivatives/rerefer/sub-{name}.set"


def study(spark, files):
    """``files``: name -> (header fields to change, block or None); a block is epoch x channel x time."""
    headers, blocks, keys = [], [], []
    for name, (changed, cube) in files.items():
        if changed is not None:
            row = dict(key=key_of(name), nbchan=3, pnts=N, trials=2, srate=RATE, xmin=-0.5, times_ms=None, channels=NAMES, data=None, dims=None)
            headers.append(tuple((row | changed).values()))
        keys.append((key_of(name), 10))
        if cube is not None:
            content = np.asarray(cube, "<f4").transpose(0, 2, 1).tobytes()
            keys.append((key_of(name).replace(".set", ".fdt"), len(content)))
            blocks.append((keys[-1][0], bytearray(content)))
    keys += [("ds1/sub-1/eeg/sub-1_x.set", 5), ("ds1/derivatives/other/sub-1.set", 5)]
    listed = manifest.with_key_parts(spark.createDataFrame(keys, "key string, size bigint"))
    return listed, spark.createDataFrame(headers, HEADER), spark.createDataFrame(blocks, "key string, content binary")


def cube(n=2):
    return np.round(RNG.normal(size=(n, 3, N)), 3).astype("f4")


def test_files_of_one_subject_stay_apart(spark):
    a, b, c = cube(), cube(), cube()
    inside = np.asarray(c, "f8").transpose(0, 2, 1)  # epoch, sample, channel
    files = {"1_run1": ({}, a), "1_run2": ({"channels": ["o2", "cz", None]}, b),
             "2": ({"data": inside.ravel().tolist(), "dims": [2, N, 3], "times_ms": [(-0.5 + i / RATE) * 1000 for i in range(N)]}, None)}
    labels = spark.createDataFrame([("ds1", "sub-1", key_of("1_run1"), 0, 1, 5.0, 3.0), ("ds1", "sub-1", key_of("1_run2"), 0, 2, 7.0, 4.0)],
                                   "dataset string, subject string, file string, event_pos int, epoch int, rating double, laser_power double")
    table, rejects = extraction.extract_files(*study(spark, files), labels)
    got = {(r.file, r.epoch): r for r in table.collect()}
    assert rejects.count() == 0 and len(got) == 6 and table.columns[:4] == ["dataset", "subject", "file", "epoch"]
    signal = {key_of("1_run1"): a[:, 0], key_of("1_run2"): b[:, 1], key_of("2"): c[:, 0]}
    rows = [("ds1", f, e, 0, "Cz", RATE, -0.5, N, s[e].astype(float).tolist()) for f, s in signal.items() for e in range(2)]
    alone = features.feature_table(spark.createDataFrame(
        rows, "dataset string, subject string, epoch int, channel_idx int, channel string, sfreq double, t0 double, n_times int, signal array<double>"))
    for r in alone.collect():
        own = got[(r.subject, r.epoch)]
        for name in features.ERP + features.COMPLEXITY + [f"psd_{b}" for b in SPEC.bands] + ["gamma_power", "alpha_erd_pct"]:
            assert own[name] == (r[name] if r[name] is None else pytest.approx(r[name], rel=1e-6)), name
        assert own["n2_amp"] is not None and own["higuchi_fd"] is not None
    assert {k: (r.rating, r.laser_power) for k, r in got.items() if r.rating is not None} == {
        (key_of("1_run1"), 0): (5.0, 3.0), (key_of("1_run2"), 1): (7.0, 4.0)}
    assert {k[0]: r.vertex_channel for k, r in got.items()} == {key_of("1_run1"): "Cz", key_of("1_run2"): "cz", key_of("2"): "Cz"}
    assert got[(key_of("1_run1"), 0)]["plv_Fz-Cz"] is not None and got[(key_of("1_run2"), 0)]["plv_Fz-Cz"] is None


def test_every_other_file_is_a_reject(spark):
    files = {"good": ({}, cube()), "a": (None, cube()), "b": ({}, None), "c": ({"pnts": None}, cube()), "d": ({}, cube(3)),
             "e": ({"data": [1.0] * 8, "dims": [2, 2, 2]}, None), "f": ({"data": [1.0] * 8, "dims": [2, 3, N]}, None),
             "g": ({"channels": NAMES[:2]}, cube()), "h": ({"xmin": None}, cube()), "i": ({"times_ms": [1.0]}, cube()),
             "j": ({"channels": ["A", "B", None]}, cube()), "k": ({"channels": None}, cube()), "l": ({"trials": None}, cube(1))}
    table, rejects = extraction.extract_files(*study(spark, files))
    assert {r.file for r in table.select("file").distinct().collect()} == {key_of("good"), key_of("l")}
    assert {r.file: (r.stage, r.reason) for r in rejects.collect()} == {key_of(k): v for k, v in {
        "a": ("header", "no header"), "b": ("block", "no signal data"), "c": ("block shape", "no channel or sample count"),
        "d": ("block size", f"{3 * 3 * N * 4} bytes for 3 x {N} x 2 values of 4"), "e": ("axes", f"no axes of 3 channels and {N} samples"),
        "f": ("block size", "data differ from their axes"), "g": ("shape", "channel count differs from names"), "h": ("times", "no time axis"),
        "i": ("shape", "sample count differs from time axis"), "j": ("channels", "no vertex channel"), "k": ("channels", "no vertex channel")}.items()}
    both = extraction.extraction(table, rejects)
    assert both.where("reason is null").count() == 3 and both.count() == 14


def test_only_named_channels_are_decoded_and_signals_stay(spark):
    listed, headers, blocks = study(spark, {"1": ({}, cube()), "2": ({"channels": ["x", "Pz", "y"]}, cube())})
    files = extraction.judged_files(listed, headers)
    epochs = extraction.file_epochs(extraction.pin(files.where("reason is null")), headers, blocks)
    assert sorted((r.file, r.channel) for r in epochs.where("epoch = 0").collect()) == [
        (key_of("1"), "Cz"), (key_of("1"), "Fz"), (key_of("2"), "Pz")]
    after = epochs._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in after
    assert {(r.subject, r.channel) for r in extraction.montage_of(files).collect()} >= {("sub-2", "Pz"), ("sub-1", "O1")}


def test_no_files(spark):
    listed, headers, blocks = study(spark, {"1": ({}, cube())})
    table, rejects = extraction.extract_files(listed.limit(0), headers.limit(0), blocks.limit(0))
    assert table.count() == 0 and rejects.count() == 0


def test_turned_tensors(spark):
    c = RNG.normal(size=(2, 3, 5))
    rows = [("epoch channel time", c.ravel().tolist(), [2, 3, 5]), ("channel time epoch", c.transpose(1, 2, 0).ravel().tolist(), [3, 5, 2]),
            ("no axes", c.ravel().tolist(), [2, 15, 1]), ("short", [1.0], [2, 3, 5]), ("flat", c.ravel().tolist(), [30]), ("none", None, None)]
    table = spark.createDataFrame(rows, "name string, data array<double>, dims array<int>").withColumns({"nbchan": F.lit(3), "pnts": F.lit(5)})
    got = {(r.name, r.epoch, r.channel_idx): r.signal for r in signals.turn_tensors(table, ["name"]).collect()}
    assert len(got) == 12
    assert all(s == c[e, i].tolist() for (_, e, i), s in got.items())


def test_stored_files_are_gathered_once_and_turned_from_their_store(spark):
    from testbed import inputs as I
    manifest, headers, blocks = I.stored_files(spark, "/root/testdata/sf0.001")
    for made in (manifest, headers, blocks):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "flatten" not in plan


def test_labels_of_files_without_features_are_left_out_before_they_are_grouped(spark):
    from testbed import inputs as I
    stored, found = I.stored_files(spark, "/root/testdata/sf0.001"), I.file_labels(spark, "/root/testdata/sf0.001")
    table, _ = extraction.extract_files(*stored, found, I.SPEC)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("min(struct(event_pos") < plan.index("LeftSemi")
    own = table.select("dataset", "subject", "file", "epoch", "rating", "laser_power")
    with_label = own.drop("rating", "laser_power").join(trials.first_event_per_epoch(found), ["dataset", "subject", "file", "epoch"], "left").select(*own.columns)
    assert own.exceptAll(with_label).count() == with_label.exceptAll(own).count() == 0 and own.where("rating is not null").count() > 0
