"""Line dedup: lines that many documents hold stay in one of them; decisions are bitmaps, so no text moves.

1. Every line that is long enough becomes a row of two 64-bit hashes of its key, its document and its position.
2. These rows are dealt by ranges of the hashes and sorted by document and position. One pass over each range sees a key's
   first occurrence, in the last document holding it, and then the ones to drop. A frequent-items sketch names the few keys
   that may be hot; they are dealt in slices as well, and their slices are put together from one row each.
3. Dropped positions become one compressed bitmap per document: words of 64 lines, runs of empty words as a gap.

All of it is SQL functions.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.storage import staged

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
# Rows of a key in one slice, and how many keys at most can be found to need several.
SLICE_ROWS, HOT_KEYS, TRACKED_KEYS = 1 << 14, 256, 16_384

_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lower(line: Column) -> Column:
    """A-Z lower-cased and nothing else; where all is ASCII the fast function does the same."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _digest(text: Column) -> Column:
    return F.xxhash64(text.isNull(), text)


def _hot_keys(lines: DataFrame, slice_rows: int) -> DataFrame:
    """h1 and slices of the keys with more rows than a slice should have; at most HOT_KEYS rows by construction."""
    found = lines.select(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {TRACKED_KEYS})").alias("top")).first().top or []
    rows = [(r["item"], -(-r["count"] // slice_rows)) for r in found if r["count"] > slice_rows]
    return lines.sparkSession.createDataFrame(rows, "h1 long, slices long")


def dropped_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """doc_id, digest of the text and `gaps` of every row of `docs` (doc_id, text) that loses lines.

    A line's key is the line without white space at its ends and without ASCII case. A key of `least_chars` code points
    or more that `least_documents` documents hold loses all its lines, save those of the largest doc_id holding it.
    `gaps` is the bitmap of dropped lines: of each 64-line word that has any, the empty words before it and its bits.

    Rows with equal doc_id count as one document, each keeping lines of its own text; rows without one count as one
    that is smaller than all others. Null and empty texts hold one empty line, which no key is. An empty table gives
    an empty one; other columns play no part.
    """
    split = docs.select(F.col("doc_id").cast("long"), _digest(F.col("text")).alias("digest"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = split.select("doc_id", "digest", "pos", F.btrim("line", F.lit(_BLANK)).alias("key")).where(F.char_length("key") >= least_chars)
    keyed = keyed.withColumns({"key": _lower(F.col("key"))})
    lines = staged(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "digest", "pos"))
    hot = F.broadcast(_hot_keys(lines, slice_rows))
    slices = F.coalesce(F.col("slices"), F.lit(1))
    dealt = lines.join(hot, "h1", "left").withColumns({"slice": F.pmod(F.xxhash64("doc_id"), slices), "hot": slices > 1}).drop("slices")

    group = ["h1", "h2", "slice"]
    last_first = Window.partitionBy(*group).orderBy(F.col("doc_id").desc_nulls_last(), "digest", "pos")
    # In the sorted stream a row begins another document where the one before has another doc_id; place counts them.
    another = (F.row_number().over(last_first) > 1) & ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(last_first))
    streamed = dealt.repartitionByRange(*group).withColumns({"another": another.cast("int")})
    streamed = streamed.withColumns({"place": 1 + F.sum("another").over(last_first)}).drop("another")
    streamed = streamed.withColumns({"documents": F.max("place").over(Window.partitionBy(*group))})
    flagged = staged(streamed.where(F.col("hot") | ((F.col("documents") >= least_documents) & (F.col("place") > 1))))

    # Slices of a hot key, put together: how many documents hold it and the largest of them.
    part = flagged.where("hot").groupBy(*group).agg(F.max("documents").alias("documents"), F.max("doc_id").alias("last"))
    whole = part.groupBy("h1", "h2").agg(F.sum("documents").alias("all_documents"), F.max("last").alias("last"))
    whole = F.broadcast(whole.where(F.col("all_documents") >= least_documents))
    columns = ["doc_id", "digest", "pos"]
    dropped = flagged.where("NOT hot").select(*columns)
    dropped = dropped.union(flagged.where("hot").join(whole, ["h1", "h2"]).where("NOT (doc_id <=> last)").select(*columns))

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = dropped.groupBy("doc_id", "digest", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    listed = words.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))

    def gap(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("w", i - 1)["word"])
        return F.struct((x["word"] - before - 1).alias("gap"), x["bits"].alias("bits"))

    return listed.select("doc_id", "digest", F.transform("w", gap).alias("gaps"))


def kept_text(text: Column, gaps: Column) -> Column:
    """The text without its dropped lines."""
    words = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(0).cast("long"), g["gap"]), F.array(g["bits"]))))

    # The words are unpacked once per text, as the only element of an array.
    unpacked = F.transform(F.array(words), lambda w: F.array_join(F.filter(_lines(text), lambda x, i: _stays(w, i)), "\n"))
    return F.when(gaps.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.element_at(unpacked, 1))


def _stays(words: Column, i: Column) -> Column:
    word = F.coalesce(F.get(words, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    return F.call_function("getbit", word, (i % 64).cast("int")) == 0


def dropped_count(gaps: Column) -> Column:
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + F.bit_count(g["bits"]))


def apply(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` with the columns n_lines, n_dropped and kept (the text without its dropped lines), which replace others of these names."""
    key = {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__digest": _digest(F.col("text"))}
    maps = dropped.select(F.coalesce("doc_id", F.lit(0)).alias("__i"), F.col("doc_id").isNull().alias("__n"), F.col("digest").alias("__d"), F.col("gaps").alias("__gaps"))
    same = (F.col("__id") == F.col("__i")) & (F.col("__digest") == F.col("__d")) & (F.col("doc_id").isNull() == F.col("__n"))
    joined = docs.withColumns(key).join(maps.hint("merge"), same, "left")
    added = {
        "n_lines": F.size(_lines(F.col("text"))).cast("long"), "n_dropped": F.coalesce(dropped_count(F.col("__gaps")), F.lit(0).cast("long")),
        "kept": kept_text(F.col("text"), F.col("__gaps")),
    }
    kept = [joined[c] for c in docs.columns if c not in added]
    return joined.select(*kept, *[value.alias(name) for name, value in added.items()])


def report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = apply(docs, dropped_lines(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


REPORT_SQL = """
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
decided AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM decided GROUP BY r
"""
