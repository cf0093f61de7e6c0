"""Exact, linearly interpolated quantiles that hold at any number of distinct values.

Spark's `percentile` keeps every distinct value of a column in one aggregation buffer. Here the wanted order
statistics are searched for instead, in the same way at every size: each round counts the values of the open brackets
in a fixed number of buckets, narrows every bracket to the bucket that holds its rank, and stops when a bracket has one
value left. A bracket with few rows has its values listed, so fifty thousand rows take one round and fifty million
evenly spread ones two. A round is one scan of the columns and a shuffle of at most buckets x brackets rows per task,
whatever the size or skew of the data.
"""

import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import quoted
from siftwell.operators.columns import nan_to_null
from siftwell.operators.facts import scan_facts
from siftwell.operators.local import fixed
from siftwell.operators.values import stacked

BUCKETS = 1024
LISTED_VALUES = 50_000
LARGEST = sys.float_info.max
BRACKET_SCHEMA = "column string, bracket int, low double, high double, listed boolean, rank bigint"


@dataclass(frozen=True)
class Span:
    """What one scan tells about a numeric column."""

    count: int
    low: float
    high: float


@dataclass
class _Search:
    column: str
    rank: int
    low: float
    high: float
    count: int

    @property
    def bracket(self) -> tuple[str, float, float]:
        return (self.column, self.low, self.high)


def spans(df: DataFrame, columns: Sequence[str]) -> dict[str, Span]:
    """Non-null count and extremes of numeric columns, columns without values left out."""
    rows = scan_facts(df.select(*map(quoted, columns))).collect()
    return {
        r["column"]: Span(r["row_count"] - r["null_count"], r["min_number"], r["max_number"])
        for r in rows
        if r["min_number"] is not None
    }


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    known: Mapping[str, Span] | None = None,
    buckets: int = BUCKETS,
    listed_values: int = LISTED_VALUES,
) -> dict[str, list[float]]:
    """column -> quantiles at `probabilities`; columns without values are left out, not-a-number is no value.

    The result is as small as its arguments, so it is returned as plain numbers.
    """
    df = nan_to_null(df)
    known = dict(spans(df, columns) if known is None else known)
    wanted = [c for c in columns if known.get(c) and known[c].count > 0]
    return _searched(df, wanted, probabilities, known, buckets, listed_values) if wanted else {}


def _searched(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    known: Mapping[str, Span],
    buckets: int,
    listed_values: int,
) -> dict[str, list[float]]:
    ranks = {c: sorted(_ranks(known[c].count, probabilities)) for c in columns}
    found: dict[tuple[str, int], float] = {}
    open_searches = []
    for c in columns:
        for rank in ranks[c]:
            search = _Search(c, rank, known[c].low, known[c].high, known[c].count)
            if search.low == search.high:
                found[c, rank] = search.low
            else:
                open_searches.append(search)
    offsets = {(s.column, s.rank): s.rank for s in open_searches}
    while open_searches:
        still_open = []
        narrowed = _narrow(df, open_searches, offsets, buckets, listed_values)
        for search in open_searches:
            key = (search.column, search.rank)
            low, high, count, before = narrowed[key]
            offsets[key] -= before
            if low == high:
                found[key] = low
            else:
                still_open.append(_Search(search.column, search.rank, low, high, count))
        open_searches = still_open
    return {
        c: [_interpolated(lambda rank, c=c: found[c, rank], known[c].count, p) for p in probabilities] for c in columns
    }


def _ranks(count: int, probabilities: Sequence[float]) -> set[int]:
    places = [(count - 1) * p for p in probabilities]
    return {r for place in places for r in (math.floor(place), math.ceil(place))}


def _interpolated(value_at, count: int, probability: float) -> float:
    place = (count - 1) * probability
    below, above = math.floor(place), math.ceil(place)
    if below == above:
        return value_at(below)
    return (above - place) * value_at(below) + (place - below) * value_at(above)


def _narrow(
    df: DataFrame,
    searches: Sequence[_Search],
    offsets: Mapping[tuple[str, int], int],
    buckets: int,
    listed_values: int,
) -> dict[tuple[str, int], tuple[float, float, int, int]]:
    """For each search: extremes and row count of the bucket holding its rank, and the rows below it."""
    spark = df.sparkSession
    still_searched = list(dict.fromkeys(s.column for s in searches))
    cells = stacked(df, still_searched, "double")
    brackets = {s.bracket: (i, s.count <= listed_values) for i, s in enumerate(searches)}
    # A handful of rows: at most two ranks per probability and column.
    bracket_rows = [(c, i, low, high, listed, 0) for (c, low, high), (i, listed) in brackets.items()]
    target_rows = [
        (s.column, brackets[s.bracket][0], s.low, s.high, False, offsets[s.column, s.rank]) for s in searches
    ]
    bracket = F.broadcast(fixed(spark, bracket_rows, BRACKET_SCHEMA).drop("rank"))
    target = F.broadcast(fixed(spark, target_rows, BRACKET_SCHEMA).select("bracket", "rank"))

    # Among the buckets infinities count as the largest finite numbers, so that every bracket has a width.
    value, low, high = (F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col(c))) for c in ("value", "low", "high"))
    # Halved before subtracting so that the width of a bracket cannot overflow.
    share = F.try_divide(value / 2 - low / 2, high / 2 - low / 2)
    # Few enough values are listed one by one; otherwise buckets of equal width, ordered like the values.
    bucket = F.when(F.col("listed") | (low == high), F.col("value")).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("double"))
    histogram = (
        cells.join(bracket, "column")
        .where(F.col("value").between(F.col("low"), F.col("high")))
        .select("bracket", bucket.alias("bucket"), "value")
        .groupBy("bracket", "bucket")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    # The window sees at most max(buckets, listed_values) rows per bracket.
    running = Window.partitionBy("bracket").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.withColumn("up_to", F.sum("n").over(running)).withColumn("before", F.col("up_to") - F.col("n"))
    holding = placed.join(target, "bracket").where(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("up_to"))
    )
    hits = {
        (r["bracket"], r["rank"]): (r["low"], r["high"], r["n"], r["before"])
        for r in holding.select("bracket", "rank", "low", "high", "n", "before").distinct().collect()
    }
    return {
        (s.column, s.rank): hits[brackets[s.bracket][0], offsets[s.column, s.rank]] for s in searches
    }
