import re

import pytest

import corpus_pipeline
from evoq.llm import queries

SF_DIR = "/root/testdata/sf0.001"
TEXT = {"id": "bigint", "text": "string"}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_stages_keep_the_columns(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert dict(docs.dtypes) == dict(documents.dtypes), name


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_each_stage_against_the_plain_rule(spark, documents):
    rows = {r.doc_id: r for r in documents.collect()}
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, documents, SF_DIR).collect()}
    assert all(re.search(r"[^\W\d_]", rows[i].text) for i in kept) and len(kept) >= 0.99 * len(rows)

    sets, order, root = {i: shingles(r.text) for i, r in rows.items()}, sorted(rows), {i: i for i in rows}
    for a in order:
        for b in order:
            if a < b and root[a] != root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    near = {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, documents, SF_DIR).collect()}
    assert near == {i for i in rows if root[i] == i}

    items = [shingles(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.benchmark_stage(spark, documents, SF_DIR).collect()}
    assert clean == {i for i in rows if not any(len(s & sets[i]) >= 0.8 * len(s) for s in items)}

    secret = corpus_pipeline.secret_stage(spark, documents, SF_DIR).collect()
    assert len(secret) == len(rows)
    for r in secret:
        assert not re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text) and r.n_chars == (len(r.text) if r.text != rows[r.doc_id].text else rows[r.doc_id].n_chars)


def test_repeated_and_null_rows(spark, documents):
    some = documents.limit(20)
    odd = some.union(some).union(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0)], documents.schema))
    out = corpus_pipeline.near_copy_stage(spark, odd, SF_DIR).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 10**6 in ids and None in [r.doc_id for r in out]
    assert corpus_pipeline.secret_stage(spark, odd, SF_DIR).count() == odd.count()
    assert corpus_pipeline.token_stage(spark, odd, SF_DIR).count() == odd.count()


def test_run_gives_ids_of_every_kept_document(spark):
    out = queries.QUERIES["pipeline"](spark, SF_DIR).collect()
    assert out and all(r.n_tokens == len(r["ids"].split()) for r in out)
