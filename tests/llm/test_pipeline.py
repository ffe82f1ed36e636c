"""The pipeline against its stages' brute-force twins."""

import hashlib

import pytest

import corpus_pipeline as p
from tests.llm.test_secrets import brute_base
from tests.llm.test_near import kept
from trackmill.llm import bpe
from trackmill.llm.decontaminate import Items, leaks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages_return_documents(stages, docs):
    assert [n for n, _ in p.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "secret_scan", "byte_bpe"]
    for s in stages[:-1]:
        assert s.dtypes == docs.dtypes


def test_near_copies_keep_the_least_id(stages):
    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    assert {r.doc_id for r in stages[1].collect()} == kept(rows)


def test_leaks_go_and_only_leaks(stages, spark):
    items = Items([(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r.doc_id for r in stages[2].collect()} == {r.doc_id for r in stages[1].collect() if not leaks(r.text.encode(), items)}


def test_secrets_are_masked_and_the_rest_stays(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    for r in stages[3].collect():
        assert not brute_base(r.text) and r.n_chars == len(r.text)
        if "[secret]" not in r.text:
            assert r.text == before[r.doc_id].text
    assert before.keys() == {r.doc_id for r in stages[3].collect()}


def test_tokens_decode_to_the_text(stages, spark):
    import public_tokenizers

    texts = {r.doc_id: r.text for r in stages[3].collect()}
    own = bpe.encoder(public_tokenizers.path(p.RANKS), public_tokenizers.PATTERN)
    got = p.run(spark, SF).collect()
    assert {r.doc_id for r in got} == texts.keys()
    for r in got:
        assert own.decode(r.ids) == texts[r.doc_id].encode() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_pass_through_every_stage(spark, odd, empty):
    for table in (odd, empty):
        rows = table
        for _, stage in p.STAGES:
            rows = stage(spark, rows, SF)
        assert rows.count() <= table.count()
