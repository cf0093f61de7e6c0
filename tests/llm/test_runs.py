import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import runs as R
from siftwell.llm.queries import QUERIES


def brute_force(ids, least=12):
    """Every stretch in which words a period apart are equal, tried period by period; longer ones keep the smallest period."""
    n, out = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j + 1)
    smallest = {(s, l): q for (s, l), q in out.items() if not any(all(ids[t] == ids[t + p] for t in range(s, s + l - p)) for p in range(1, q))}
    return sorted(((s, l, q) for (s, l), q in smallest.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
        ids = [rng.randrange(k) for _ in range(n)]
        if n > 20 and rng.random() < 0.5:
            a, p = rng.randrange(n // 2), rng.randint(1, 12)
            ids = ids[:a] + [ids[a + (i - a) % p] for i in range(a, n)]
        least = rng.choice([12, 12, 6, 2])
        assert R.runs(np.array(ids, np.int64), least) == brute_force(ids, least), (ids, least)


def test_squares_of_a_long_periodic_text():
    assert R.runs(np.arange(30_000) % 7_000) == [(0, 30_000, 7_000)]
    assert R.runs(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_force(w)
    dropped = {i for s, l, q in found for i in range(s + q, s + l)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{l},{q}\n" for s, l, q in found)
    return (doc_id, len(found), *row, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_query_equals_brute_force(spark, sf_dir):
    short = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6_000]
    rows = {r.doc_id: tuple(r) for r in QUERIES["op11_runs"](spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for doc_id, text in short:
        assert rows[doc_id] == expected(doc_id, text)


def test_awkward_rows(spark, docs, no_docs):
    long = ["one two three " * 40, "a" * 100_000, "x " * 5_000, None, ""]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(1_000 + i, t) for i, t in enumerate(long)], "doc_id long, text string"))
    rows = frame.collect()
    got = sorted((tuple(r) for r in R.report(frame).collect()), key=str)
    assert got == sorted((expected(r.doc_id, r.text) for r in rows), key=str)
    assert R.report(no_docs).count() == 0


def test_own_columns_replace_and_others_stay(spark):
    frame = spark.createDataFrame([(1, "a b " * 8, "mine", 5)], "runs int, text string, collapsed string, extra int")
    out = R.collapse(frame)
    assert sorted(out.columns) == ["collapsed", "extra", "runs", "text"]
    row = out.first()
    assert (row.collapsed, row.extra) == ("a b", 5) and tuple(row.runs[0]) == (0, 16, 2)


@pytest.mark.parametrize("words", [11, 12])
def test_least_length(spark, words):
    out = R.collapse(spark.createDataFrame([(" ".join("ab"[i % 2] for i in range(words)),)], "text string")).select(F.size("runs")).first()
    assert out[0] == (words == 12)
