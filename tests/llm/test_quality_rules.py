import re
from collections import Counter

from pyspark.sql import functions as F

from siftwell.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(three)
    covered = {i + k for i, w in enumerate(three) if often[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts_of_every_text(docs):
    for row in rules.quality_rules(docs).collect():
        found = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)
        assert found == brute(row.text)
        assert row.kept == (not row.failed_rules) and (not row.base_failed or not row.kept)


def test_repeats_overlap_and_lines_differ_by_space(spark):
    cases = ["a b c a b c a b c", "a a a a", "x y z\nx y z\n x y z\nq", "a b\n\n \na b", "p q r s t p q r"]
    found = rules.quality_rules(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    for row in found:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == brute(row.text)


def test_verdict_follows_the_table(spark, texts):
    prose = texts[0]
    cases = {
        prose: True, " ".join(w + "$$$" for w in prose.split()): False, prose.upper() + " x": True,
        " | ".join(prose.split()): False, " ".join(w + "!!" for w in prose.split()): False, "\n".join("- " + w * 2 for w in prose.split()): False,
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r.text: r.kept for r in rules.quality_rules(df).collect()} == cases
    assert {r.text for r in rules.kept(df).collect()} == {t for t, good in cases.items() if good}
    everything = rules.quality_rules(df, rules=(), base=())
    assert everything.where("kept").count() == len(cases)


def test_clashing_columns_are_replaced_and_empty_tables_stay_empty(docs, no_docs):
    clash = docs.withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "row": F.lit(2), "judged": F.lit(3)})
    out = rules.quality_rules(clash)
    assert out.count() == docs.count() and dict(out.dtypes)["n_words"] == "bigint"
    assert set(rules.kept(clash).columns) == set(clash.columns)
    assert rules.report(no_docs).count() == 0 and rules.kept(no_docs).columns == no_docs.columns


def test_one_projection_without_python(docs):
    plan = rules.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange RoundRobin", "").replace("Exchange SinglePartition", "") and "Python" not in plan
