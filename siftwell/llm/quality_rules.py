"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a Column over the words and lines of the whole text, so scoring a corpus is a single pass
without a shuffle; a text never leaves its task. The table is data: pass another one to change the verdict.
"""

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import words

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in",
    "is", "it", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "we", "were", "which",
    "with", "you",
    "als", "am", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "er",
    "es", "für", "ich", "im", "ist", "mit", "nicht", "sich", "sie", "sind", "und", "von", "war", "werden", "wie", "zu", "zum",
    "au", "aux", "avec", "ce", "cette", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "mais", "ne",
    "par", "pas", "plus", "pour", "que", "qui", "sa", "ses", "son", "sur", "un", "une",
    "al", "como", "con", "del", "el", "ha", "las", "lo", "los", "más", "no", "o", "para", "pero", "por", "se", "su", "sus",
    "y",
)


class Rule(NamedTuple):
    """Keep a document while `low` <= measure <= `high`; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# Measures of a text, by name: one count over another, which counts as one at least, or a count alone.
MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "ellipsis_line_share": ("n_ellipsis_lines", "n_lines"),
    "bullet_line_share": ("n_bullet_lines", "n_lines"),
    "n_words": ("n_words", None),
}

#: The verdict beyond the base rules; bounds hold for whole texts.
RULES = (
    Rule("word length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop words", "stop_word_share", 0.04, None),
    Rule("repeated lines", "dup_line_share", None, 0.5),
    Rule("trailing dots", "ellipsis_line_share", None, 0.5),
    Rule("bullets", "bullet_line_share", None, 0.9),
)

#: What a document must hold in any case.
BASE_RULES = (
    Rule("enough words", "n_words", 50, None),
    Rule("repeated passages", "repeat_word_share", None, 0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_stop_words", "n_ellipsis_lines", "n_bullet_lines")


def _holds(rule: Rule, counts: Column) -> Column:
    above, below = MEASURES[rule.measure]
    measure, holds = counts[above], F.lit(True)
    if below:
        measure = measure / F.greatest(counts[below], F.lit(1))
    if rule.low is not None:
        holds = holds & (measure >= rule.low)
    if rule.high is not None:
        holds = holds & (measure <= rule.high)
    return holds


def _all(rules: tuple[Rule, ...], counts: Column) -> Column:
    return reduce(lambda holds, rule: holds & _holds(rule, counts), rules, F.lit(True))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(found: Column) -> Column:
    """(hash, place) of each three-word window, sorted, so that equal windows lie side by side."""
    places = F.when(F.size(found) >= 3, F.sequence(F.lit(0), F.size(found) - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(
        F.transform(places, lambda i: F.struct(F.xxhash64(found[i], found[i + 1], found[i + 2]).alias("h"), i.alias("i")))
    )


def _repeated(windows: Column) -> Column:
    """Places of windows that occur twice or more, in order."""
    last = F.size(windows) - 1
    twice = F.filter(
        windows,
        lambda w, k: ((k > 0) & (F.get(windows, k - 1)["h"] == w["h"]))
        | ((k < last) & (F.get(windows, k + 1)["h"] == w["h"])),
    )
    return F.sort_array(F.transform(twice, lambda w: w["i"]))


def _covered(places: Column) -> Column:
    """How many words the windows at these places cover, each word once."""
    return F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )


def _counts(text: Column, found: Column, lines: Column) -> Column:
    counts = {
        "n_words": F.size(found),
        "word_chars": F.length(F.array_join(found, "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _let(_windows(found), lambda windows: _let(_repeated(windows), _covered)),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(found, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))),
    }
    return F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)


def judged(text: Column, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> Column:
    """A struct of the counts of a text, `base_failed`, `kept` and `failed_rules`, the names of all rules that do not hold.

    Null counts as an empty text, and an empty text has zero of everything. Windows are told apart by a 64-bit
    hash within their own text.
    """
    every = (*base, *rules)

    def verdict(counts: Column) -> Column:
        failed = [F.when(~_holds(rule, counts), F.lit(rule.name)) for rule in every]
        return F.struct(
            *[counts[name].alias(name) for name in (*COUNTS, *MORE_COUNTS)],
            (~_all(base, counts)).alias("base_failed"),
            _all(every, counts).alias("kept"),
            F.array_compact(F.array(*failed).cast("array<string>")).alias("failed_rules"),
        )

    whole = F.coalesce(text, F.lit(""))
    return _let(whole, lambda t: _let(words(t), lambda w: _let(_lines(t), lambda x: _let(_counts(t, w, x), verdict))))


def quality_rules(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES
) -> DataFrame:
    """`docs` with the fields of `judged`, by projection alone.

    A column of `docs` that has the name of a field is replaced. Repeated rows are judged one by one, and an empty
    table gives an empty one.
    """
    fields = (*COUNTS, *MORE_COUNTS, "base_failed", "kept", "failed_rules")
    inner = docs.select(F.struct("*").alias("row"), judged(F.col(text), rules, base).alias("judged"))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in fields]
    return inner.select(*others, *[F.col("judged")[f].alias(f) for f in fields])


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass every rule, with the columns they came with."""
    return docs.where(judged(F.col(text))["kept"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and both verdicts of every row."""
    return quality_rules(docs.select("doc_id", "text")).select(
        "doc_id", *COUNTS, "base_failed", "kept", "n_stop_words", "n_lines"
    )


def _verdict_sql(rules: tuple[Rule, ...]) -> str:
    over = {name: f"{a} / greatest({b}, 1)" if b else a for name, (a, b) in MEASURES.items()}
    bounds = [(over[r.measure], r.low, r.high) for r in rules]
    return " AND ".join(
        [f"{m} >= {low}" for m, low, _ in bounds if low is not None] + [f"{m} <= {high}" for m, _, high in bounds if high is not None]
    )


#: The same report in the SQL of DuckDB, from the same tables of thresholds and stop words.
REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT * FROM (SELECT r, unnest(list_zip(words, words[2:], words[3:])) AS window3, unnest(range(1, len(words) + 1)) AS i,
  len(words) AS n FROM w) WHERE i <= n - 2),
twice AS (SELECT r, unnest(list(i)) AS i FROM win GROUP BY r, window3 HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x: list_contains({list(STOP_WORDS)}, lower(x))))::BIGINT AS n_stop_words,
  len(lines)::BIGINT AS n_lines,
  len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…')))::BIGINT AS n_ellipsis_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]')))::BIGINT AS n_bullet_lines
  FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  NOT ({_verdict_sql(BASE_RULES)}) AS base_failed, {_verdict_sql((*BASE_RULES, *RULES))} AS kept, n_stop_words, n_lines
FROM m"""
