import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def test_each_row_gets_its_own_decision(spark, words_of):
    """Null ids and ids repeated with different texts."""
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 8)
    text = lambda seed: " ".join(words_of(100, seed, 9999))
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], documents.schema).repartition(3)
    near = table([(1, text(1)), (None, text(1)), (2, text(2)), (2, text(3)), (3, text(4)), (2, text(4)), (None, text(5)), (None, text(5)), (4, text(1)), (5, ""), (5, "")])
    out = sorted((repr(r.doc_id), r.text) for r in corpus_pipeline.near_copy_stage(spark, near, SF_DIR).collect())
    assert out == sorted([("1", text(1)), ("2", text(2)), ("2", text(3)), ("2", text(4)), ("None", text(5)), ("5", "")])

    leaks = table([(None, f"{text(6)} {item} {text(7)}"), (7, text(8)), (7, f"{text(9)} {item}"), (None, text(10))])
    assert {r.text for r in corpus_pipeline.benchmark_stage(spark, leaks, SF_DIR).collect()} == {text(8), text(10)}

    key = "AKIA" + "Q" * 14
    held = table([(None, f"a {key}"), (8, f"{key} b"), (8, f"some words before {key} c"), (8, "no key at all")])
    out = sorted((repr(r.doc_id), r.text, r.n_chars) for r in corpus_pipeline.secret_stage(spark, held, SF_DIR).collect())
    assert out == sorted((i, t, len(t)) for i, t in [("None", "a [secret]"), ("8", "[secret] b"), ("8", "some words before [secret] c"), ("8", "no key at all")])
