import re

import pytest
from pyspark.sql import functions as F

from siftwell.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at the limit, share the excess anew, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in names}
        above = {s for s in names if out[s] > most * sizes[s] * (1 + 1e-12) and s not in full}
        if not above:
            return out
        full |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_words_taken(docs):
    clash = docs.withColumns({"size": F.lit("x"), "place": F.lit(0), "block": F.lit(0), "taken": F.lit(1)})
    rows = mixing.report(clash).collect()
    source = {}
    for r in docs.collect():
        source.setdefault((r.doc_id, words(r.text)), r.source)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"]) for r in rows) == sorted((r.doc_id is not None, r.doc_id or 0, words(r.text)) for r in docs.collect())
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id, r["size"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    expected = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_WORDS
    again = mixing.report(clash).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_limits_pass_the_excess_on(spark):
    data = [(1, "a", 20), (2, "b", 4000), (3, "c", 300), (4, "é", 100), (5, None, 5000), (6, "Z", 0)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, s, n in data], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.report(df).collect()}
    expected = targets({s: n for _, s, n in data})
    assert all(out[i].target == pytest.approx(expected[s]) and out[i].source_size == n for i, s, n in data)
    assert all(out[i].taken <= 3 * n for i, _, n in data)


def test_every_slot_once_and_blocks_evenly(spark):
    text = " ".join(["w"] * 1000)
    df = spark.createDataFrame([(i, text, f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    mixture = mixing.mix(df, shard_slots=64)
    slots = mixture.slots.collect()
    assert len({(s.place, s.slot) for s in slots}) == len(slots)
    assert len({(s.place, s["pass"], s.block) for s in slots}) == len(slots)
    per_shard = {}
    for s in slots:
        per_shard[s.shard, s.place] = per_shard.get((s.shard, s.place), 0) + 1
    wanted = {r.place: r.share for r in mixture.sources.collect()}
    full = [shard for shard in {s.shard for s in slots} if shard < max(s.shard for s in slots)]
    assert all(abs(per_shard.get((shard, p), 0) - 64 * share) <= 2 for shard in full for p, share in wanted.items())


def test_copies_follow_the_words_taken(docs, no_docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.where("size(split(trim(coalesce(text, '')), ' ')) = 0").count() == 0
    assert out.groupBy("doc_id", "text").count().where("count > 6").count() == 0
    assert mixing.report(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    wordless = docs.where("text IS NULL OR trim(text) = ''")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.report(wordless).collect())
