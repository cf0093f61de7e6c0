"""Per-column measurements that profiling, scoring and detection read from.

Every function returns one row per column, so whatever joins or broadcasts them is bounded by the
width of the table and not by its length.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import (
    has_fraction,
    normalize_text,
    number_text,
    parse_clean_date,
    parse_number,
    parse_number_lenient,
    quoted,
    state_code_of_normalized,
)
from siftwell.operators.columns import kind_of, numeric_columns
from siftwell.operators.local import fixed
from siftwell.operators.values import stacked, text_values, typed_groups


def scan_facts(df: DataFrame) -> DataFrame:
    """(position, column, kind, row_count, null_count, min_number, max_number) from one pass.

    A single ungrouped aggregate: each task sends one row to the final stage.
    """
    numeric = set(numeric_columns(df))
    aggregates = [F.count("*").alias("rows")]
    for i, name in enumerate(df.columns):
        aggregates.append(F.count(quoted(name)).alias(f"n{i}"))
        if name in numeric:
            aggregates.append(F.min(quoted(name)).cast("double").alias(f"lo{i}"))
            aggregates.append(F.max(quoted(name)).cast("double").alias(f"hi{i}"))
    missing = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(kind_of(field.dataType)).alias("kind"),
            F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
            (F.col(f"lo{i}") if field.name in numeric else missing).alias("min_number"),
            (F.col(f"hi{i}") if field.name in numeric else missing).alias("max_number"),
        )
        for i, field in enumerate(df.schema)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def null_share(null_count: Column, row_count: Column) -> Column:
    return null_count / F.greatest(row_count, F.lit(1))


def _share_counts() -> list[Column]:
    """Row counts of the values a column's text can be read as, and the extremes found there."""
    n = F.col("n")

    def rows_where(c: Column) -> Column:
        return F.sum(F.when(c, n).otherwise(0))

    return [
        F.sum(n).alias("non_null"),
        F.sum("chars").alias("chars"),
        rows_where(F.col("number").isNotNull()).alias("numeric_count"),
        rows_where(F.col("lenient").isNotNull()).alias("lenient_count"),
        rows_where(F.col("moment").isNotNull()).alias("date_count"),
        rows_where(F.col("state").isNotNull()).alias("state_count"),
        F.coalesce(F.max(has_fraction(F.col("number"))), F.lit(False)).alias("has_fraction"),
        F.min("number").alias("low_number"),
        F.max("number").alias("high_number"),
        # Whole numbers beyond what a double tells apart.
        F.min("whole").alias("low_whole"),
        F.max("whole").alias("high_whole"),
        F.min("moment").alias("low_moment"),
        F.max("moment").alias("high_moment"),
    ]


def _with_readings(df: DataFrame, norm: str) -> DataFrame:
    """Add what the text reads as; numbers and dates read the same from normalised text as from the raw cell."""
    # Upper case in a step of its own, so that it is evaluated once and not in every notation of dates.
    return df.withColumn("upper", F.upper(norm)).select(
        "*",
        parse_number(F.col(norm)).alias("number"),
        F.when(F.trim(norm).rlike(r"^[+-]?\d{1,38}$"), F.trim(norm).try_cast("decimal(38,0)")).alias("whole"),
        parse_number_lenient(F.col(norm)).alias("lenient"),
        parse_clean_date(F.col("upper")).alias("moment"),
    )


def text_facts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """How the text of each column reads, and how many values it holds raw and normalised.

    Exact: distinct values first, then everything is evaluated once per distinct value and weighted.
    Otherwise: no shuffle of values at all, distinct counts from HyperLogLog++ sketches.
    """
    if not exact:
        norm = normalize_text(F.col("value"))
        rows = stacked(df, columns).select(
            "column", "value", norm.alias("norm"), F.lit(1).alias("n"), F.length("value").alias("chars")
        )
        return (
            _with_readings(rows.withColumn("state", state_code_of_normalized(F.col("norm"))), "norm")
            .groupBy("column")
            .agg(
                *_share_counts(),
                F.approx_count_distinct("value").alias("distinct_count"),
                F.approx_count_distinct("norm").alias("normalized_count"),
            )
        )
    norm, state = F.col("norm_key"), F.col("state")
    is_code = F.col("value_key") == state
    # The state follows from the normalised key, so grouping by both makes no more groups.
    spellings = (
        text_values(df, columns)
        .withColumn("state", state_code_of_normalized(norm))
        .groupBy("column", "norm_key", "state")
        .agg(
            F.sum("n").alias("n"),
            F.max("n").alias("top_n"),
            F.sum("chars").alias("chars"),
            F.count("*").alias("variants"),
            F.count_if(is_code).alias("coded"),
            F.sum(F.when(is_code, F.col("n")).otherwise(0)).alias("coded_n"),
        )
    )
    return (
        _with_readings(spellings, "norm_key")
        .groupBy("column")
        .agg(
            *_share_counts(),
            F.sum("variants").alias("distinct_count"),
            F.count("*").alias("normalized_count"),
            F.sum(F.col("n") - F.col("top_n")).alias("variant_rows"),
            F.sum(F.when(state.isNotNull(), F.col("variants") - F.col("coded")).otherwise(0)).alias("state_variants"),
            F.sum(F.when(state.isNotNull(), F.col("n") - F.col("coded_n")).otherwise(0)).alias("state_variant_rows"),
        )
    )


def _extreme_text(kind: str, c: Column) -> Column:
    if kind == "float":
        return number_text(c.cast("double"))
    return c.cast("string") if kind in ("integer", "date") else F.lit(None).cast("string")


def typed_facts(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, distinct_count, low, high) of the columns that are not text, extremes as text."""
    parts = []
    for kind, cells in typed_groups(df):
        if kind == "text":
            continue
        distinct = F.count("*") if exact else F.approx_count_distinct("value")
        values = cells.distinct() if exact else cells
        per_column = values.groupBy("column").agg(
            distinct.alias("distinct_count"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        extremes = [_extreme_text(kind, F.col(c)).alias(c) for c in ("low", "high")]
        parts.append(per_column.select("column", "distinct_count", *extremes))
    if not parts:
        return fixed(df.sparkSession, [], "column string, distinct_count bigint, low string, high string")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
