import hashlib
from collections import defaultdict

import pytest

from siftwell.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANK).translate(LOWER)


def expected(rows, least_documents=5):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    last = {
        k: max(ids, key=lambda d: (d is not None, d)) for k, ids in holders.items() if len(k) >= 40 and len(ids) >= least_documents
    }
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def answered(frame, **options):
    from pyspark.sql import functions as F

    found = L.apply(frame, L.dropped_lines(frame, **options))
    return sorted(map(tuple, found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    common = "This line is Common to very many of the documents é"
    other = "another line that some documents hold, long enough"
    out = [(i, f"own {i}\n {common.upper() if i % 2 else common}\t\n{other if i < 4 else 'x'}\n\n" + f"{common}\n" * (i % 3)) for i in range(40)]
    # Exactly forty code points in five documents, thirty-nine in five, É and é, trailing breaks.
    out += [(100 + i, "\n" + "ü" * 40 + "\n" + "v" * 39 + "\n" + ("É" if i % 2 else "é") * 50) for i in range(5)]
    # Repeated and missing ids, repeated rows, many lines, empty texts.
    out += [(3, common), (3, common), (None, common), (None, f"{other}\n{other}"), (300, None), (301, ""), (302, "\n")]
    out += [(400, "\n".join(f"{common if k % 70 == 0 else k}" for k in range(1_000)))]
    return out


@pytest.mark.parametrize("slice_rows", [4, 1 << 14])
def test_equals_brute_force(spark, rows, slice_rows):
    """With slices of four rows all common keys are dealt as hot ones."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert answered(frame, slice_rows=slice_rows) == expected(rows)


def test_awkward_documents(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert answered(docs) == expected(rows)
    assert answered(docs, least_documents=2) == expected(rows, 2)
    assert L.report(no_docs).count() == 0
    clash = docs.withColumnRenamed("source", "kept").withColumnRenamed("lang", "n_lines")
    out = L.apply(clash, L.dropped_lines(clash))
    assert sorted(out.columns) == sorted([*clash.columns, "n_dropped"])


def test_nothing_but_sql_functions(docs):
    plan = L.dropped_lines(docs)._jdf.queryExecution().toString() + L.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
