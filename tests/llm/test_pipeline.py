"""The pipeline against its stages followed by brute force."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftwell.llm import pii, quality_rules
from siftwell.storage import staged
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_pii import brute as personal


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        steps.append(docs)
    good, distinct, clean, mixed, encoded = steps
    assert all(step.columns == columns for step in steps[:-1])

    kept = {r.doc_id for r in quality_rules.report(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    component = groups([(i, before[i]) for i in sorted(kept)])
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(i for i in kept if component[i] == i)

    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {r.doc_id for r in distinct.collect()}
    for r in clean.collect():
        assert not personal(r.text) and r.n_chars == len(r.text)
        if not pii.candidates(before[r.doc_id]) and not personal(before[r.doc_id]):
            assert r.text == before[r.doc_id]

    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= set(texts) and max(copies.values()) <= 4
    words = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    assert abs(sum(words[i] * n for i, n in copies.items()) / sum(words.values()) - 1) < 0.25

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = encoded.collect()
    assert len(rows) == sum(copies.values())
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_corpus(spark, docs):
    """Null, empty and very long texts, repeated and missing ids, copies, and columns with names that stages use themselves."""
    clash = {c: F.lit(i) for i, c in enumerate(("kept", "key", "label", "spans", "size", "taken", "n_tokens", "__copy", "gaps"))}
    corpus = docs.withColumns(clash)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, corpus = corpus, staged(stage(spark, corpus, ""))
        assert corpus.columns == [*docs.columns, *clash]
        assert {r.doc_id for r in corpus.collect()} <= {r.doc_id for r in before.collect()}
    encoded = staged(corpus_pipeline.STAGES[-1][1](spark, corpus, ""))
    assert encoded.count() == corpus.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(encoded.columns)


def test_empty_corpus(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ""))
    assert docs.count() == 0
