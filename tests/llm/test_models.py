"""The two networks: held-out accuracy, gradients, awkward texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import language, quality_model
from siftwell.llm.training import fold, windows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_folds(spark):
    ids = spark.range(200).select("id", fold(F.col("id"), 5).alias("five"), fold(F.col("id"), 4).alias("four")).collect()
    assert all((r.five, r.four) == (zlib.crc32(str(r.id).encode()) % 5, zlib.crc32(str(r.id).encode()) % 4) for r in ids)


def test_windows_hold_every_byte():
    raw = [b"", b"a", b"b" * 10, bytes(range(97, 120))]
    rows, owner = windows(raw, 10, 7, 256)
    for i, text in enumerate(raw):
        own = rows[owner == i]
        joined = b"".join(bytes(int(b) for b in (row[:7] if k < len(own) - 1 else row) if b != 256) for k, row in enumerate(own))
        assert joined == text


def test_language_on_held_out_documents(labelled):
    docs, _ = labelled
    out = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 150 and (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_of_awkward_texts(docs, no_docs):
    rows = language.report(docs.withColumn("lang_pred", F.lit("x"))).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for row in rows:
        if row.doc_id is not None and not any(c.isalpha() for c in texts[row.doc_id] or ""):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.lang_pred == "en" and 0 <= row.score <= 1
    assert language.report(no_docs).count() == 0


def test_backpropagation_through_time():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language._start(3, rng).items()}
    x, y = rng.integers(97, 110, (6, 4)), np.array([0, 1, 2, 1])

    def loss():
        states = np.concatenate([language._read(w, "f", x), language._read(w, "b", x)], axis=2).astype(np.float64)
        p = language._softmax(states @ w["out"] + w["out_bias"])
        return -np.log(p[:, np.arange(4), y]).mean()

    grads = language._grads(w, x, y)
    for name, place in (("fstate", (2, 5)), ("bstate", (1, 20)), ("fin", (int(x[2, 1]), 3)), ("bbias", (17,)), ("out", (3, 1))):
        before, step = w[name][place], 1e-2
        w[name][place] = before + step
        up = loss()
        w[name][place] = before - step
        slope = (up - loss()) / (2 * step)
        w[name][place] = before
        assert abs(slope - grads[name][place]) < 2e-4 + 0.05 * abs(slope)


def test_quality_on_held_out_documents(labelled):
    docs, labels = labelled
    out = quality_model.report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 60 and (out.predicted == out.quality).mean() > 0.85
    assert (out.predicted == (out.score >= 0.7)).all()


def test_quality_of_awkward_texts(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = quality_model.report(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    none = quality_model.report(docs, labels.limit(0)).collect()
    assert all(r.score == pytest.approx(0.5) and r.predicted == 0 for r in none)
    assert quality_model.report(no_docs, labels).count() == 0


def test_quality_gradients():
    rng = np.random.default_rng(1)
    w = quality_model._start(rng)
    chunks = rng.integers(97, 122, (3, quality_model.SEEN, quality_model.CHUNK)).astype(np.int16)
    sizes, y, weight = np.array([2000, 100, 700]), np.array([1.0, 0, 1], np.float32), np.ones(3, np.float32)

    def loss():
        pooled = quality_model._pooled(w, chunks.reshape(-1, quality_model.CHUNK)).reshape(3, quality_model.SEEN, -1)
        features = np.hstack([pooled.mean(1), pooled.max(1), quality_model._log_length(sizes)[:, None]])
        z = quality_model._logit(w, features)[0].astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = quality_model._grads(w, chunks, sizes, y, weight)
    for name, place in (("out", (3,)), ("in", (5, 2)), ("in", (40, 7)), ("filter", (9, 4)), ("bias", (6,))):
        before, step = float(w[name][place]), 2e-3
        w[name][place] = before + step
        up = loss()
        w[name][place] = before - step
        slope = (up - loss()) / (2 * step)
        w[name][place] = before
        assert abs(slope - grads[name][place]) < 1e-3 + 0.1 * abs(slope)
