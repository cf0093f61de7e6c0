"""Value frequencies: one narrow (column, value) shuffle shared by everything that reads values.

Rows are combined before the shuffle, so a value that fills a third of the table crosses the
network once per map task, and per-column results come from a second, equally combined grouping.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import normalize_text, quoted, value_key
from siftwell.functions.text import is_plain_key
from siftwell.operators.columns import columns_of_kind
from siftwell.operators.local import fixed


def stacked(df: DataFrame, columns: Sequence[str], cast: str | None = None) -> DataFrame:
    """The non-null cells of `columns` as (column, value) rows."""
    cells = [(quoted(c).cast(cast) if cast else quoted(c)).alias(c) for c in columns]
    long = df.select(*cells).unpivot([], [quoted(c) for c in columns], "column", "value")
    return long.where(F.col("value").isNotNull())


def _text_form(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(quoted(name))
    if isinstance(data_type, T.BinaryType):
        return F.hex(quoted(name))
    return quoted(name).cast("string")


def _as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Booleans, arrays, structs, maps and binaries in a text form that tells values apart."""

    return df.select(*[_text_form(df, c).alias(c) for c in columns])


def typed_groups(df: DataFrame, columns: Sequence[str] | None = None) -> list[tuple[str, DataFrame]]:
    """(kind, stacked cells) per physical kind, so that no value is cast to text to be counted."""
    wanted = set(df.columns if columns is None else columns)
    groups = []
    decimals: dict[str, list[str]] = {}
    for f in df.schema:
        if f.name in wanted and isinstance(f.dataType, T.DecimalType):
            decimals.setdefault(f.dataType.simpleString(), []).append(f.name)
    for cast, names in decimals.items():
        groups.append(("float", stacked(df, names, cast)))
    exact = {name for names in decimals.values() for name in names}
    for kind, cast in (("integer", "bigint"), ("float", "double"), ("date", "timestamp_ntz")):
        names = [c for c in columns_of_kind(df, kind) if c in wanted and c not in exact]
        if names:
            groups.append((kind, stacked(df, names, cast)))
    for kind in ("text", "boolean", "nested"):
        names = [c for c in columns_of_kind(df, kind) if c in wanted]
        if names:
            groups.append((kind, stacked(df if kind == "text" else _as_text(df, names), names)))
    return groups


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of one column, nulls left out."""
    value = quoted(column)
    return df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def text_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value_key, norm_key, n, chars): one row per distinct text value.

    Texts beyond the key length are represented by a digest, so document-sized columns are counted
    exactly without sending the documents themselves through the shuffle. Only those are normalised
    row by row; for the others it is enough to normalise each distinct value afterwards.
    """
    value, key = F.col("value"), F.col("value_key")
    keyed = stacked(df, columns).select(
        "column",
        value_key(value).alias("value_key"),
        F.when(~is_plain_key(value), value_key(normalize_text(value))).alias("long_norm"),
        F.length(value).alias("chars"),
    )
    grouped = keyed.groupBy("column", "value_key", "long_norm").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    norm = F.coalesce("long_norm", value_key(normalize_text(key)))
    return grouped.select("column", "value_key", norm.alias("norm_key"), "n", "chars")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) with each column's most frequent value as text, the lowest on ties.

    The highest count per column comes first and the values that reach it second, both from the same
    shuffled counts, so that distinct values are hashed and never sorted.
    """
    tops = []
    for _, cells in typed_groups(df, columns):
        counted = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
        highest = counted.groupBy("column").agg(F.max("n").alias("n"))
        most = counted.join(F.broadcast(highest), ["column", "n"]).groupBy("column").agg(F.min("value").alias("value"))
        tops.append(most.select("column", F.col("value").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, tops)


def sample_values(df: DataFrame, size: int = 4) -> DataFrame:
    """(column, sample_values): the lowest `size` distinct non-null values of every column, as text.

    Each round finds the lowest value above the last one, for all columns in one ungrouped aggregate, so
    no values are shuffled however many distinct ones there are. The outcome has one row per column.
    """
    nested = columns_of_kind(df, "nested")
    shown = df.select(*[_text_form(df, c).alias(c) if c in nested else quoted(c) for c in df.columns])
    last: dict[str, Column] = {}
    drawn: dict[str, list[str]] = {c: [] for c in df.columns}
    left = list(df.columns)
    for _ in range(size):
        if not left:
            break
        above = [F.when(quoted(c) > last[c], quoted(c)) if c in last else quoted(c) for c in left]
        lowest = [F.min(c).alias(f"v{i}") for i, c in enumerate(above)]
        texts = [F.col(f"v{i}").cast("string").alias(f"t{i}") for i in range(len(left))]
        row = shown.agg(*lowest).select(*texts).first()
        kinds = {f.name: f.dataType for f in shown.schema}
        for c, text in zip(list(left), row):
            if text is None:
                left.remove(c)
            else:
                drawn[c].append(text)
                last[c] = F.lit(text).cast(kinds[c])
    return fixed(df.sparkSession, list(drawn.items()), "column string, sample_values array<string>")
