"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoq.functions import numbers, text
from evoq.session import ANONYMOUS_STORE
from evoq.sources import labels, manifest, sidecars, signals, tables


@pytest.fixture
def store(tmp_path):
    def put(key, content):
        path = tmp_path / "store" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return path
    put("ds001/participants.tsv", "participant_id\tGender\tAge\nsub-1\tF\t20\nsub-2\tM\tn/a\n")
    put("ds002/participants.tsv", "participant_id\tGender\tEnergy\nsub-1\tM\t4.25\n")
    put("ds001/sub-1/eeg/sub-1_task_events.tsv", "onset\tduration\tsample\tvalue\n0.5\tn/a\t512\tS 1\n1.5\t0\t1536\tn/a\n")
    put("ds001/sub-2/eeg/sub-2_task_events.tsv", "onset\tvalue\ttrial\r\n0.25\tS 2\t7\r\n0.75\r\n")
    put("ds002/sub-4/eeg/sub-4_task_events.tsv", "onset\tvalue\tvalue\n0.125\ta\tb\tc\n")
    put("ds002/sub-3/eeg/sub-3_task_events.tsv", "")
    put("ds001/sub-1/eeg/sub-1_task_events.json", '{"onset": {"Units": "s"}}')
    put("ds001/sub-2/eeg/sub-2_task_events.json", '{"onset": {"Units": "s"}}')
    put("ds002/sub-3/eeg/sub-3_task_events.json", b"not json \xff" + b"x" * 2000)
    put("ds001/derivatives/rerefer/sub-1.set", b"set")
    return tmp_path / "store"


def test_listing(spark, store):
    found = manifest.with_key_parts(manifest.list_objects(spark, str(store)))
    keys = {r["key"]: r for r in found.collect()}
    assert len(keys) == 9  # the empty event file is not listed
    row = keys["ds001/derivatives/rerefer/sub-1.set"]
    assert (row["dataset"], row["subject"], row["derivative"], row["basename"], row["ext"], row["size"]) == \
        ("ds001", "sub-1", "rerefer", "sub-1.set", ".set", 3)
    assert manifest.list_objects(spark, str(store), "*.set").count() == 1
    datasets = spark.createDataFrame([("ds001",), ("ds009",)], "accession string")
    assert [r["accession"] for r in manifest.missing_datasets(datasets, found).collect()] == ["ds009"]


def test_fallback_to_raw_sets(spark):
    keys = ["a/derivatives/x/s.set", "a/s.set", "b/s.set", "b/t.set", "b/t.fdt"]
    m = manifest.with_key_parts(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {r["key"] for r in manifest.preferred_sets(m).collect()} == {"a/derivatives/x/s.set", "b/s.set", "b/t.set"}
    siblings = manifest.with_sibling(m.where("ext = '.set'"), m, ".fdt", "fdt")
    assert {r["key"]: r["fdt"] for r in siblings.collect()}["b/t.set"] == "b/t.fdt"


def test_participants(spark, store):
    paths = {d: f"{store}/{d}/participants.tsv" for d in ("ds001", "ds002", "ds003")}
    got = tables.read_participants(spark, paths)
    assert got.columns == ["participant_id", "Gender", "Age", "dataset", "Energy"]
    rows = {(r["dataset"], r["participant_id"]): r for r in got.collect()}
    assert len(rows) == 3
    assert rows["ds001", "sub-1"]["Age"] == 20.0 and rows["ds001", "sub-2"]["Age"] is None
    assert rows["ds002", "sub-1"]["Energy"] == 4.25 and rows["ds002", "sub-1"]["Age"] is None
    none = tables.read_participants(spark, {"ds003": paths["ds003"]})
    assert none.count() == 0 and "participant_id" in none.columns


def test_event_files(spark, store):
    rows = {(r["subject"], r["onset"]): r for r in tables.read_event_files(spark, str(store)).collect()}
    assert set(rows) == {("sub-1", 0.5), ("sub-1", 1.5), ("sub-2", 0.25), ("sub-2", 0.75), ("sub-4", 0.125)}
    assert rows["sub-2", 0.75]["value"] is None and rows["sub-2", 0.75]["extra"] == {"trial": None}
    assert rows["sub-4", 0.125]["value"] == "a" and rows["sub-4", 0.125]["extra"] == {"value.1": "b", "_3": "c"}
    one = rows["sub-1", 0.5]
    assert (one["duration"], one["sample"], one["value"], one["dataset"]) == (None, 512, "S 1", "ds001")
    assert rows["sub-1", 1.5]["value"] is None
    assert rows["sub-2", 0.25]["extra"] == {"trial": "7"} and rows["sub-2", 0.25]["sample"] is None


def test_sidecars(spark, store):
    read = sidecars.read_sidecars(spark, str(store))
    distinct = {r["dataset"]: r for r in sidecars.distinct_contents(read).collect()}
    assert distinct["ds001"]["n_copies"] == 2 and "sub-1" in distinct["ds001"]["key"]
    shown = {r["dataset"]: r["preview"] for r in sidecars.first_contents(read).collect()}
    assert json.loads(shown["ds001"]) == {"onset": {"Units": "s"}}
    assert shown["ds002"].startswith("not json �x") and len(shown["ds002"]) == 1500


def test_label_rows(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text("\n".join(json.dumps(r) for r in [
        {"dataset": "d", "subject": "s", "event_pos": 0, "epoch": "1", "rating": "5", "laser_power": "3.5"},
        {"dataset": "d", "subject": "s", "event_pos": 1, "epoch": "1", "rating": "9"},
        {"dataset": "d", "subject": "s", "event_pos": 2, "rating": "NaN"},
        {"dataset": "d", "subject": "s", "event_pos": 3, "epoch": "3", "rating": "[]"}]))
    rows = labels.coerce(labels.read_labels(spark, str(path))).orderBy("event_pos").collect()
    assert [r["rating"] for r in rows] == [5.0, 9.0, None, None]
    assert [r["epoch"] for r in rows] == [1, 1, None, 3]
    assert rows[0]["code"] is None
    from evoq.operators import trials
    files = spark.createDataFrame([("d", "s", 3), ("d", "empty", 0)], "dataset string, subject string, n_epochs int")
    by_epoch = trials.first_event_per_epoch(labels.coerce(labels.read_labels(spark, str(path))))
    got = {(r["subject"], r["epoch"]): r["rating"] for r in trials.reindex(by_epoch, files).collect()}
    assert got == {("s", 0): 5.0, ("s", 1): None, ("s", 2): None}


def test_float_blocks(spark, tmp_path):
    data = np.arange(3 * 5 * 2, dtype="<f4").reshape((3, 5, 2), order="F")
    good, bad = tmp_path / "sub-1.fdt", tmp_path / "sub-2.fdt"
    good.write_bytes(data.tobytes(order="F"))
    bad.write_bytes(b"\0" * 8)
    alone, unknown = tmp_path / "sub-3.fdt", tmp_path / "sub-4.fdt"
    alone.write_bytes(b"\0" * 4)
    unknown.write_bytes(b"\0" * 4)
    shapes = spark.createDataFrame([(f"file:{p}", 3, 5, 2) for p in (good, bad)] + [(f"file:{unknown}", None, 5, 2)],
                                   "path string, nbchan int, pnts int, trials int")
    blocks = signals.read_float_blocks(spark, str(tmp_path), shapes)
    got = {(r["epoch"], r["channel_idx"]): r["signal"] for r in signals.decode_float_blocks(blocks).collect()}
    assert len(got) == 6
    assert all(got[e, c] == data[c, :, e].tolist() for e in range(2) for c in range(3))
    rejects = {r["path"][-9:]: r for r in signals.block_rejects(blocks).collect()}
    assert set(rejects) == {"sub-2.fdt", "sub-3.fdt", "sub-4.fdt"} and "8 bytes" in rejects["sub-2.fdt"]["reason"]
    assert {rejects[f"sub-{i}.fdt"]["stage"] for i in (3, 4)} == {"block shape"}
    large = {(r["epoch"], r["channel_idx"]): r["signal"] for r in signals.decode_large_block(spark, str(good), 3, 5).collect()}
    assert large == got


def test_blocks_by_ranges(spark, tmp_path):
    pick = np.random.default_rng(3)
    shapes, want = [], {}
    for name, trials in (("small", 1), ("mid", 5), ("long", 11), ("one", 1)):
        times = 400 if name == "one" else 8
        data = pick.normal(size=(trials, times, 4)).astype("<f4")
        (tmp_path / f"{name}.fdt").write_bytes(data.tobytes())
        shapes.append((f"file:{tmp_path}/{name}.fdt", 4, times, None if name == "small" else trials, [2, 0]))
        want |= {(name, e, c): data[e, :, c].tolist() for e in range(trials) for c in (2, 0)}
    (tmp_path / "bad.fdt").write_bytes(b"\0" * 4000)
    (tmp_path / "empty.fdt").write_bytes(b"")
    shapes += [(f"file:{tmp_path}/bad.fdt", 4, 8, 11, [0]), (f"file:{tmp_path}/empty.fdt", 0, 8, 1, [0])]
    table = spark.createDataFrame(shapes, "path string, nbchan int, pnts int, trials int, wanted array<int>")
    blocks = signals.read_float_blocks(spark, str(tmp_path), table)
    for limit in (0, 300, 10**6):  # all by ranges, some of them, none
        rows = signals.stored_signals(blocks, wanted="wanted", limit=limit, range_bytes=300).collect()
        assert len(rows) == len(want)
        assert {(r["path"].split("/")[-1][:-4], r["epoch"], r["channel_idx"]): r["signal"] for r in rows} == want
    plan = signals.decode_block_ranges(blocks)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "MapInArrow" in plan
    assert {r["path"].split("/")[-1] for r in signals.block_rejects(blocks).collect()} == {"bad.fdt"}
    assert signals.decode_block_ranges(blocks.limit(0)).count() == 0


def test_all_objects(spark, tmp_path):
    made = {"a/b/c/deep.set": b"12", "a/.hidden": b"1", "_mark": b"", "a/empty.tsv": b"", "a/b/é x:y.txt": b"123"}
    for key, content in made.items():
        path = tmp_path / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (tmp_path / "folder without objects").mkdir()
    for root in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        rows = manifest.list_all_objects(spark, root).collect()
        assert len(rows) == len(made) and {r["key"]: r["size"] for r in rows} == {k: len(v) for k, v in made.items()}
    assert manifest.list_all_objects(spark, str(tmp_path / "absent")).count() == 0


def test_orientation(spark):
    x = np.arange(2 * 4 * 8).reshape(2, 4, 8)
    cells = lambda name, a, n_channels=4: [("d", name, *map(int, i), float(a[i]), n_channels, 8) for i in np.ndindex(a.shape)]
    rows = cells("straight", x) + cells("swapped", x.transpose(0, 2, 1)) + cells("first", x.transpose(1, 2, 0)) + cells("bad", x, 5)
    df = spark.createDataFrame(rows, "dataset string, subject string, a0 int, a1 int, a2 int, v double, n_channels int, n_times int")
    got = {(r["subject"], r["epoch"], r["channel_idx"]): r["signal"] for r in signals.orient(df).collect()}
    assert len(got) == 3 * 8
    for name in ("straight", "swapped", "first"):
        assert all(got[name, e, c] == x[e, c].tolist() for e in range(2) for c in range(4))
    assert [(r["subject"], r["stage"]) for r in signals.orient_rejects(df).collect()] == [("bad", "axes")]


def test_orientation_of_as_many_epochs_as_channels(spark):
    x = np.arange(4 * 4 * 8).reshape(4, 4, 8)
    rows = [("d", "s", *map(int, i), float(x[i]), 4, 8) for i in np.ndindex(x.shape)]
    df = spark.createDataFrame(rows, "dataset string, subject string, a0 int, a1 int, a2 int, v double, n_channels int, n_times int")
    got = {(r["epoch"], r["channel_idx"]): r["signal"] for r in signals.orient(df).collect()}
    assert all(got[e, c] == x[e, c].tolist() for e in range(4) for c in range(4))


def test_shape_rejects_of_absent_and_undeclared_files(spark):
    epochs = spark.createDataFrame([("d", "a", 0, 0, [1.0, 2.0]), ("d", "b", 0, 0, [1.0])], "dataset string, subject string, epoch int, channel_idx int, signal array<double>")
    files = spark.createDataFrame([("d", "a", 1, 2, 3), ("d", "c", 1, 2, 3)], "dataset string, subject string, n_channels int, n_times int, ndim int")
    good, bad = signals.check_shapes(epochs, files)
    assert [r["subject"] for r in good.collect()] == ["a"]
    assert {r["subject"]: r["reason"] for r in bad.collect()} == {"b": "no declared shape", "c": "no signals"}


def test_label_rejects_and_large_numbers(spark):
    schema = "dataset string, subject string, events array<struct<epoch: string, rating: string>>, event struct<epoch: string, rating: string>"
    files = spark.createDataFrame([("d", "one", None, ("1e12", "3")), ("d", "none", [], None), ("d", "no field", None, None), ("d", "list", [("2", "1"), ("2", "5")], None)], schema)
    assert {r["subject"]: r["reason"] for r in labels.event_rejects(files).collect()} == {"none": "no events", "no field": "no event field"}
    rows = {(r["subject"], r["event_pos"]): r["epoch"] for r in labels.coerce(labels.explode_events(files)).collect()}
    assert rows == {("one", 0): None, ("list", 0): 2, ("list", 1): 2}


def test_inventory_keeps_hidden_and_empty_objects(spark):
    df = spark.createDataFrame([(".bidsignore", 5), ("ds1/", 0), ("ds1/_x", 0), (None, 1)], "key string, size int")
    assert sorted(map(tuple, manifest.from_inventory(df).collect())) == [(".bidsignore", 5), ("ds1/_x", 0)]


def test_time_axis(spark):
    rows = [("a", [-500.0, 0.0], None, None, None), ("b", None, -0.5, 64.0, 3), ("c", None, -0.5, None, 2), ("d", None, None, 64.0, 3)]
    df = spark.createDataFrame(rows, "f string, times_ms array<double>, xmin double, srate double, pnts int")
    got = {r["f"]: r["times"] for r in signals.with_times(df).collect()}
    assert got == {"a": [-0.5, 0.0], "b": [-0.5, -0.5 + 1 / 64, -0.5 + 2 / 64], "c": [-0.5, -0.499], "d": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "dataset string, x double")
    tables.write_parquet(df, str(tmp_path / "p"))
    tables.write_csv(df, str(tmp_path / "c"))
    assert (tmp_path / "p" / "dataset=a").is_dir()
    back = tables.read_features_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, back.collect())) == [("a", 1.5), ("b", 2.5)]


def test_text_functions(spark):
    keys = ["ds1/sub-01/x_events.tsv", "ds1/derivatives", "ds1/derivatives/rerefer/sub-A2.set", "README", "a.b/c"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    k = F.col("k")
    rows = [tuple(r) for r in df.select(text.subject_of(k), text.subject_folder_of(k), text.derivative_of(k), text.with_suffix(k, ".fdt")).collect()]
    assert rows == [("sub-01", "sub-01", "unknown", "ds1/sub-01/x_events.fdt"), ("unknown", None, "unknown", "ds1/derivatives.fdt"),
                    ("sub-A2", None, "rerefer", "ds1/derivatives/rerefer/sub-A2.fdt"), ("unknown", None, "unknown", "README.fdt"),
                    ("unknown", None, "unknown", "a.b/c.fdt")]
    assert text.guess_column(["ID", "Age", "stage"], ["age"]) == "Age"
    assert text.guess_column(["pain_rating", "rating"], ["pain"], exact="rating") == "rating"
    assert text.guess_column(["x"], ["age"]) is None


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("[]",), (None,)], "s string")
    assert [r[0] for r in df.select(numbers.to_number(F.col("s"))).collect()] == [1.5, None, None, None]
    pairs = spark.createDataFrame([(4.0, 1.0), (0.0, 1.0), (float("nan"), 1.0)], "b double, t double")
    assert [r[0] for r in pairs.select(numbers.percent_change(F.col("b"), F.col("t"))).collect()] == [75.0, None, None]


def test_anonymous_store_settings():
    assert "Anonymous" in ANONYMOUS_STORE["spark.hadoop.fs.s3a.aws.credentials.provider"]


@pytest.mark.parametrize("content, value", [
    ("12 and more", None), ('{"k": 1} tail', None), ("1], [2", None), ("1}, {", None), ("1, 2", None), ('1, "b": 2', None), ('[1]]', None), ("", None), ("7 ]", None),
    (' {"k": 1}\n', '{"k":1}'), ("12", "12"), ("null", "null"), ("[1, 2]", "[1,2]"), ('"]"', '"]"'), (None, None)])
def test_only_a_whole_text_is_json(spark, content, value):
    rows = spark.createDataFrame([("a", content)], "key string, content string")
    assert sidecars.parsed(rows).select(F.to_json("json")).first()[0] == value
    assert rows.select(text.json_preview(F.col("content"))).first()[0] == (value or content)


def test_a_folder_per_value_is_written_by_one_task(spark, tmp_path):
    rows = spark.range(0, 3000, numPartitions=8).select(F.concat(F.lit("sub-"), (F.col("id") % 3).cast("string")).alias("subject"), F.col("id").alias("sample"))
    tables.write_by(rows, "subject", "sample", str(tmp_path / "few" / "ds1"))
    assert len(list((tmp_path / "few").rglob("*.csv"))) == 3
    hot = rows.union(spark.range(3000, 3500).select(F.lit("sub-0"), "id"))
    tables.write_by(hot, "subject", "sample", str(tmp_path / "hot" / "ds1"), per_task=1100, per_file=400)
    assert len({p.name.split("-")[1] for p in (tmp_path / "hot").rglob("*sub-0/*.csv")}) == 2
    read = tables.read_event_files(spark, str(tmp_path / "hot"), glob="*.csv")
    assert sorted(r[0] for r in read.select("sample").collect()) == list(range(3500))
