import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import jaccard_join as join
from siftwell.llm.components import components


def shingles(text):
    words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def brute(rows):
    """Component of each doc_id, rows with equal ids being one document."""
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 90 * len(a | b):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {i: find(i) for i in root}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    expected = brute(rows)
    out = join.jaccard_join(df).collect()
    assert len(out) == len(rows)
    assert sorted(r.n_shingles for r in out) == sorted(len(shingles(t)) for _, t in rows)
    assert all(r.component_id == expected[r.doc_id] for r in out if r.doc_id is not None)
    return out


def test_awkward_texts(docs, texts):
    out = check(docs)
    # The row without an id has the set of document 4.
    assert [r.component_id for r in out if r.doc_id is None] == [4]


def test_chains_and_groups(spark):
    """Chains of near copies whose ends are no copies, a large group, passages that many documents share."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(120)]
    for k in range(12):
        base = [*base]
        base[5 + 9 * k] = word()
        rows.append(" ".join(base))
    base = [word() for _ in range(100)]
    for _ in range(60):
        copy = [*base]
        copy[rng.randrange(100)] = word()
        rows.append(" ".join(copy))
    rows += [" ".join([*(word() for _ in range(rng.randint(20, 60))), *passage, *(word() for _ in range(20))]) for _ in range(40)]
    rows += [" ".join(rng.choice(passage) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows, 100)), "doc_id long, text string").repartition(5)
    out = check(df)
    assert len({r.component_id for r in out}) < len(rows) - 60


def connected(n, pairs):
    tree = list(range(n))
    for a, b in pairs:
        old, new = tree[a], tree[b]
        tree = [new if t == old else t for t in tree]
    return {frozenset(i for i in range(n) if tree[i] == t) for t in tree}


def test_tries_agree_with_sets():
    rng = np.random.default_rng(4)
    for percent in (50, 80, 90, 100):
        for blocks in (1, 2):
            base, sets = rng.choice(400, 200, replace=False).astype(np.uint64), []
            for _ in range(60):
                if rng.random() < 0.1:
                    base = rng.choice(400, rng.integers(1, 300), replace=False).astype(np.uint64)
                more = rng.choice(np.arange(400, 500), rng.integers(0, 12), replace=False).astype(np.uint64)
                sets.append(np.sort(np.concatenate([base[rng.random(len(base)) < rng.uniform(0.85, 1)], more])))
            sets = [s for s in [*sets, sets[0]] if len(s)]
            own, block = rng.random(len(sets)) < 0.7, rng.integers(0, blocks, len(sets))
            overlap = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)}
            links = [
                (i, j) for (i, j), o in overlap.items()
                if (own[i] or own[j]) and (len(set(block)) == 1 or block[i] != block[j]) and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o)
            ]
            sizes = np.array(list(map(len, sets)))
            # Beginnings of the sets must connect whatever whole sets do.
            begun = join.linked([s[: len(s) - -(-len(s) * percent // 100) + 1 + len(s) // 20] for s in sets], sizes, own, block, percent)
            trees = connected(len(sets), begun)
            assert all(any({i, j} <= tree for tree in trees) for i, j in links)
            found = join.linked(sets, sizes, own, block, percent)
            assert set(found) <= set(links) | {(j, i) for i, j in links}
            assert connected(len(sets), found) == connected(len(sets), links) and len(found) < len(sets)


def copies(rng, n, words, changed):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, out = [word() for _ in range(words)], []
    for _ in range(n):
        copy = [*base]
        for i in rng.sample(range(words), changed):
            copy[i] = word()
        out.append(" ".join(copy))
    return out


def test_copies_just_below_the_threshold(spark, monkeypatch):
    """Copies that differ from one another by about a tenth of their n-grams; small blocks make several tasks of the group."""
    monkeypatch.setattr(join, "BLOCK_GRAMS", 2_000)
    df = spark.createDataFrame(list(enumerate(copies(random.Random(6), 150, 100, 2))), "doc_id long, text string").repartition(4)
    out = check(df)
    assert 1 < len({r.component_id for r in out}) <= 150


def test_rows_grow_with_members(spark):
    """Two thousand copies below the threshold, none of which links: few rows each are moved, however many pairs there are."""
    df = spark.createDataFrame(list(enumerate(copies(random.Random(7), 2_000, 60, 3))), "doc_id long, text string").repartition(4)
    rows, labels = join._labelled(df, 3, 90)
    keyed = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    counts = join._counted(keyed, 3)
    prefixes = {r[0]: join._ordered(join.grams(r[1], 3), counts) for r in df.collect()}
    first = [(str(i).encode(), len(g), g[: len(g) - -(-len(g) * 90 // 100) + 1].view(np.int64).tolist()) for i, g in prefixes.items()]
    members = join._groups(spark.createDataFrame(first, "key binary, n long, prefix array<long>"), 90)
    assert members.count() <= 12 * 2_000
    assert rows.count() == 2_000


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    out = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for link in links for n in link}
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert out == {n: r for n, r in root.items() if any(n in link and link[0] != link[1] for link in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives_keep_one_row_each(docs, no_docs):
    clash = docs.withColumns({"component_id": F.lit(1), "key": F.lit("k"), "node": F.lit(0)})
    kept = join.representatives(clash)
    assert kept.columns == clash.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(ids) == sorted(i for i, c in expected.items() if i == c)
    assert join.representatives(no_docs).count() == 0 and join.jaccard_join(no_docs).count() == 0


def test_representatives_of_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(50)) for _ in range(6)]
    near = " ".join([*texts[3].split()[:-1], "end"])
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (None, near), (9, texts[3]), (None, texts[4])]
    rows += [(5, texts[5]), (5, texts[5]), (6, None), (6, None), (None, ""), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, join.representatives(df).collect()), key=str)
    alone = [(6, None), (6, None), (None, ""), (None, " ")]
    assert kept == sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (9, texts[3]), (None, texts[4]), (5, texts[5]), *alone], key=str)


def test_representatives_at_five_words(spark):
    """Near copies at five words and 80 % that three words and 90 % keep apart."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    near = [*base[:60], word(), word(), *base[62:90], word(), word(), *base[92:]]
    rows = [(7, " ".join(base)), (3, " ".join(near)), (5, " ".join(word() for _ in range(80)))]
    grams = [{tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for n in (3, 5) for _, t in rows[:2]]
    assert len(grams[0] & grams[1]) / len(grams[0] | grams[1]) < 0.9 and len(grams[2] & grams[3]) / len(grams[2] | grams[3]) >= 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in join.representatives(df, 5, 80).collect()) == [3, 5]
    assert sorted(r.doc_id for r in join.representatives(df).collect()) == [3, 5, 7]
