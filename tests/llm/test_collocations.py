import random
import re
from collections import Counter

import pytest

from siftwell.llm import collocations as C
from siftwell.llm.bits import bits

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, top, least=10, share=50):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang in sizes:
        found = {k[1:]: n for k, n in counts.items() if k[0] == lang}
        longer = Counter()
        for p, n in found.items():
            if len(p) == 3 and n >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], n)
        rows = []
        for p, a in found.items():
            if len(p) > 1 and a >= least and not (longer[p] and 100 * longer[p] >= share * a):
                score, _, l, r = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["the", "of", "New", "York", "City", "É", "é", "a", "b"] + [f"w{i}" for i in range(25)]
    out = []
    for i in range(120):
        parts = []
        for _ in range(60):
            parts.append(rng.choice(["new york city", "New York", "such as", "a b a b", rng.choice(vocabulary), rng.choice(vocabulary)]))
            if rng.random() < 0.2:
                parts[-1] += rng.choice([",", ".", "\n", "\t", " ; ", "!?", "\x0b"])
        out.append((["en", "de", None, "und"][i % 4], " ".join(parts)))
    return [*out, ("en", None), ("en", ""), ("fr", "too short, to tell"), ("xx", " . ! "), *[("en", "a b c d")] * 15]


@pytest.mark.parametrize(("top", "opened"), [(2_000, 2), (10, 1), (3, 1), (1, 1)])
def test_equals_brute_force(spark, rows, top, opened, monkeypatch):
    """Small `top`s begin with a narrow frontier, so that several rounds are needed."""
    monkeypatch.setattr(C, "OPEN", opened)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, C.collocations(frame, top).collect())) == expected(rows, top)


def test_equal_pairs_are_combined():
    (a, b), n = C._combined([C.np.array(c, C.np.uint64) for c in zip((1, 2), (1, 3), (1, 2), (4, 2))])
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(1, 2, 2), (1, 3, 1), (4, 2, 1)]


def test_awkward_documents(docs, no_docs):
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, C.collocations(docs, 50).collect())) == expected(rows, 50)
    assert C.collocations(no_docs).count() == 0


def test_scores_beyond_64_bits(spark):
    big = [(3_000_000_007, 3_000_000_011, 3_000_000_019), (2_999_999_999_999, 3_000_000_000_000, 3_000_000_000_001), (10, 4_000_000_000_000, 10)]
    frame = spark.createDataFrame(big, "a long, l long, r long").select("a", "l", "r", C._score("a", "l", "r").alias("score"))
    assert all(r.score == 10**6 * r.a * r.a // (r.l * r.r) for r in frame.collect())


def test_bit_tables_miss_nothing(spark):
    keys = [(i * 7_919**3 % 2**62, -i) for i in range(5_000)]
    table = bits(spark.createDataFrame(keys, "x long, y long"), "x", "y")
    x, y = map(C.np.array, zip(*keys))
    assert table.hit(x, y).all()
    assert table.hit(x + 1, y).mean() < 0.01
    assert not bits(spark.createDataFrame([], "x long"), "x").table.any()
