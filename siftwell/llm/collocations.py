"""Phrase collocation mining: phrases of two or three words, scored by how much their parts belong together.

Growth is best first and bounded. Words are counted, then pairs of words that are frequent enough, all of them exactly.
The counts of a pair bound the score of every phrase that grows from it: a phrase that begins with the pair scores at
most count(pair) / count(first word), one that ends with it at most count(pair) / count(last word). The frontier opens
at the score of a language's `top`-th pairs: pairs whose bound reaches it are grown, and so are pairs that reach it
themselves, since a longer phrase may displace them. What is left unopened scores less than that. Where fewer than
`top` phrases survive at or above the threshold, it is lowered and the frontier opened further, until each language is
settled with all its ties.

Words are known by a 64-bit hash of language and word, phrases by those of their words. Tasks combine counts before they
are shuffled. They are told what to grow by bit tables of a fixed size; a wrong hit costs a count that nothing uses.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.batches import slices
from siftwell.llm.bits import Bits, bits
from siftwell.llm.shared import ship
from siftwell.storage import staged

TOP, LEAST, SHARE = 2_000, 10, 50
SCALE = 1_000_000
# The frontier opens at the score of this many times `top` pairs, and so many times more in each further round.
OPEN, WIDER = 2, 8
# Words that a task collects before it combines their phrases, and words it keeps hashed.
TOGETHER, KEPT_WORDS = 1 << 22, 300_000
# Rows of a table of languages that are broadcast.
MOST_LANGUAGES = 100_000

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SEPARATED = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
# Stands between pieces in arrays of words.
_BREAK = b"\n"


class _Words(dict):
    """Hashes of one language's words; 0 is the end of a piece."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        return value


_known: dict[str, _Words] = {}


def _hashes(lang: str) -> _Words:
    if sum(map(len, _known.values())) > KEPT_WORDS:
        _known.clear()
    return _known.setdefault(lang, _Words(lang))


def _tokens(text: str) -> list[bytes]:
    """Words in lower case and a break wherever a piece ends."""
    return [*filter(None, text.encode().lower().translate(_SEPARATED).replace(_BREAK, b" \n ").split(b" ")), _BREAK]


def _gathered(batches: Iterator[pa.RecordBatch], named: bool = False) -> Iterator[tuple[str, np.ndarray, dict[int, bytes]]]:
    """Languages with hashes of words, many texts at a time, and, if asked for, the words behind the hashes."""
    held: dict[str, list[np.ndarray]] = {}
    names: dict[str, dict[int, bytes]] = {}
    total = 0
    for batch in batches:
        for part in slices(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                found, known = _tokens(text), _hashes(lang)
                held.setdefault(lang, []).append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
                if named:
                    names.setdefault(lang, {}).update((known[w], w) for w in set(found))
                total += len(found)
            if total > TOGETHER:
                yield from ((k, np.concatenate(v), names.get(k, {})) for k, v in held.items())
                held, names, total = {}, {}, 0
    yield from ((k, np.concatenate(v), names.get(k, {})) for k, v in held.items())


def _combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each occurs. Rows with equal mixed hashes may stay apart; they are summed later."""
    mixed = reduce(lambda h, c: (h ^ (h >> np.uint64(29)) ^ c) * _MIX[0], columns, np.uint64(0))
    order = np.argsort(mixed)
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _signed(column: np.ndarray) -> pa.Array:
    return pa.array(column.view(np.int64), pa.int64())


def _words(docs: DataFrame) -> DataFrame:
    """lang, h, word and f of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, x, names in _gathered(batches, named=True):
            h, n = np.unique(x[x != 0], return_counts=True)
            langs = pa.array([lang] * len(h), pa.string())
            yield pa.RecordBatch.from_arrays(
                [langs, _signed(h), pa.array([names[i].decode() for i in h.tolist()], pa.string()), pa.array(n, pa.int64())], ["lang", "h", "word", "n"]
            )

    found = docs.mapInArrow(run, "lang string, h long, word string, n long")
    return found.groupBy("lang", "h").agg(F.min("word").alias("word"), F.sum("n").alias("f"))


def _pairs(docs: DataFrame, frequent: Bits) -> DataFrame:
    """h1, h2 and f of neighbouring words of which each is marked as frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, _ in _gathered(batches):
            good = (x != 0) & shared.value.hit(x)
            at = np.flatnonzero(good[:-1] & good[1:])
            (a, b), n = _combined([x[at], x[at + 1]])
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(n, pa.int64())], ["h1", "h2", "n"])

    return docs.mapInArrow(run, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("f"))


def _grown(docs: DataFrame, frequent: Bits, begins: Bits, ends: Bits, settled: Bits) -> DataFrame:
    """h1, h2, h3 and f of phrases that grow from pairs of the frontier, or that may displace one of its pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, begins, ends, settled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, begins, ends, settled = shared.value
        for _, x, _ in _gathered(batches):
            at = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
            pair = np.zeros(len(x), bool)
            pair[at] = frequent.hit(x[at], x[at + 1])
            at = np.flatnonzero(pair[:-2] & pair[1:-1])
            a, b, c = x[at], x[at + 1], x[at + 2]
            wanted = (begins.hit(a, b) & ends.hit(b, c)) | settled.hit(a, b) | settled.hit(b, c)
            (a, b, c), n = _combined([a[wanted], b[wanted], c[wanted]])
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(b), _signed(c), pa.array(n, pa.int64())], ["h1", "h2", "h3", "n"])

    return docs.mapInArrow(run, "h1 long, h2 long, h3 long, n long").groupBy("h1", "h2", "h3").agg(F.sum("n").alias("f"))


def _score(a: str, l: str, r: str) -> Column:
    """floor(SCALE * a * a / (l * r)) without rounding; the factors are decimals of 38 digits."""
    big = [f"CAST({c} AS decimal(15,0))" for c in (a, a, l, r)]
    return F.expr(f"({big[0]} * {big[1]} * CAST({SCALE} AS decimal(7,0))) div ({big[2]} * {big[3]})")


def _thresholds(pairs: DataFrame, langs: DataFrame, place: int) -> DataFrame:
    """lang and t: the score of the pair at this place, or 0 where there are fewer."""
    best = Window.partitionBy("lang").orderBy(F.col("score").desc())
    at = pairs.select("lang", "score", F.row_number().over(best).alias("place")).where(F.col("place") <= place)
    at = at.where(F.col("place") == place).select("lang", F.col("score").alias("t"))
    return langs.join(at, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def _beside(langs: DataFrame) -> DataFrame:
    """A written table with one row per language, to be broadcast where it is counted to be small, as languages are."""
    return F.broadcast(langs) if langs.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else langs.hint("merge")


def _survivors(docs: DataFrame, words: DataFrame, pairs: DataFrame, thresholds: DataFrame, least: int, share: int) -> DataFrame:
    """All phrases that reach their language's threshold and that no longer one displaces."""
    reach = pairs.join(_beside(thresholds), "lang")
    opened = staged(reach.select(
        "lang", "h1", "h2", "f", "f1", "f2", "score", "t",
        (F.col("f") * SCALE >= F.col("t") * F.col("f1")).alias("begins"), (F.col("f") * SCALE >= F.col("t") * F.col("f2")).alias("ends"),
        (F.col("score") >= F.col("t")).alias("settled"),
    ))
    marks = [bits(opened.where(c), "h1", "h2") for c in ("true", "begins", "ends", "settled")]
    grown = staged(_grown(docs, *marks).where(F.col("f") >= least))

    first = opened.select("lang", "t", "h1", "h2", F.col("f").alias("f12"), "f1")
    second = opened.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f").alias("f23"), F.col("f2").alias("f3"))
    triples = grown.join(first.hint("merge"), ["h1", "h2"]).join(second.hint("merge"), ["h2", "h3"])
    cut1, cut2 = _score("f", "f1", "f23"), _score("f", "f12", "f3")
    triples = triples.withColumns({"cut1": cut1, "cut2": cut2}).withColumns({"score": F.least("cut1", "cut2")}).where(F.col("score") >= F.col("t"))
    early = F.col("cut1") <= F.col("cut2")
    triples = triples.select(
        "lang", F.array("h1", "h2", "h3").alias("hs"), F.col("f").alias("a"), F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), "score",
    )
    inside = grown.select("h1", "h2", "f").union(grown.select("h2", "h3", "f")).groupBy("h1", "h2").agg(F.max("f").alias("longer"))
    kept = opened.where("settled").join(inside.hint("merge"), ["h1", "h2"], "left")
    kept = kept.where(F.coalesce("longer", F.lit(0)) * 100 < F.col("f") * share)
    kept = kept.select("lang", F.array("h1", "h2").alias("hs"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    return staged(kept.union(triples))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` best phrases of each language.

    `docs` has lang and text. Texts, A-Z in lower case, are split at .,;:!? and line breaks into pieces and those at spaces
    and tabs into words. A phrase is two or three words of a piece with a count `a` of `least` or more. Its score is
    a millionth of a * a / (l * r), rounded down, for the cut into counts l and r with the lowest one. A phrase is left
    out if a longer one that contains it has `share` hundredths of its count or more. Ranks go by score, count and phrase.

    A null lang counts as `und`; null and empty texts have no words; repeated rows count again; other columns play no
    part. Languages without phrases have no rows, an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = staged(_words(docs))
    sizes = staged(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = staged(words.where(F.col("f") >= least))
    pairs = _pairs(docs, bits(frequent, "h")).where(F.col("f") >= least)
    pairs = pairs.join(frequent.select("lang", F.col("h").alias("h1"), F.col("f").alias("f1")).hint("merge"), "h1")
    pairs = pairs.join(frequent.select(F.col("h").alias("h2"), F.col("f").alias("f2")).hint("merge"), "h2")
    pairs = staged(pairs.withColumns({"score": _score("f", "f1", "f2")}))

    langs, done, place = sizes.select("lang"), [], OPEN * top
    while True:
        thresholds = staged(_thresholds(pairs, langs, place))
        found = _survivors(docs, frequent, pairs, thresholds, least, share)
        counted = found.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = staged(thresholds.join(counted, "lang", "left").select("lang", ((F.col("t") == 0) | (F.coalesce("found", F.lit(0)) >= top)).alias("settled")))
        done.append(found.join(state.where("settled").hint("merge"), "lang").drop("settled"))
        langs, place = state.where("NOT settled").select("lang"), place * WIDER
        if langs.isEmpty():
            break

    names = frequent.select("h", "word")
    out = reduce(DataFrame.union, done)
    spelled = out.select("hs", F.posexplode("hs").alias("place", "h")).distinct().join(names.hint("merge"), "h")
    spelled = spelled.groupBy("hs").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = out.join(spelled.hint("merge"), "hs").withColumns({"rank": F.row_number().over(best).cast("long")}).where(F.col("rank") <= top)
    return ranked.join(_beside(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


REPORT_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
f1 AS (SELECT lang, w[i] AS phrase, count(*) AS f FROM placed GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i+1] AS y, w[i] || ' ' || w[i+1] AS phrase, count(*) AS f FROM placed WHERE i + 1 <= len(w) GROUP BY ALL),
f3 AS (
  SELECT lang, w[i] AS x, w[i+2] AS z, w[i] || ' ' || w[i+1] AS xy, w[i+1] || ' ' || w[i+2] AS yz,
    w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS phrase, count(*) AS f FROM placed WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10
),
cuts AS (
  SELECT b.lang, b.phrase, 1 AS k, b.f AS a, x.f AS l, y.f AS r FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.phrase = b.x
    JOIN f1 y ON y.lang = b.lang AND y.phrase = b.y
    LEFT JOIN (SELECT lang, part, max(f) AS f FROM (SELECT lang, xy AS part, f FROM f3 UNION ALL SELECT lang, yz, f FROM f3) GROUP BY ALL) t
      ON t.lang = b.lang AND t.part = b.phrase
    WHERE b.f >= 10 AND (t.f IS NULL OR 100 * t.f < 50 * b.f)
  UNION ALL
  SELECT t.lang, t.phrase, 1, t.f, x.f, yz.f FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.phrase = t.x JOIN f2 yz ON yz.lang = t.lang AND yz.phrase = t.yz
  UNION ALL
  SELECT t.lang, t.phrase, 2, t.f, xy.f, z.f FROM f3 t JOIN f2 xy ON xy.lang = t.lang AND xy.phrase = t.xy JOIN f1 z ON z.lang = t.lang AND z.phrase = t.z
),
scored AS (SELECT *, CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
) JOIN sizes USING (lang) WHERE rank <= 2000
"""
