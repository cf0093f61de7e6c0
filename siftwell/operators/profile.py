"""Column profiling: counts, distinct values, extremes, samples and logical types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import number_text
from siftwell.operators.columns import nan_to_null, text_columns
from siftwell.operators.facts import null_share, scan_facts, text_facts, typed_facts
from siftwell.operators.values import sample_values

RECOGNISED_SHARE = 0.9
IDENTIFIER_SHARE = 0.95
IDENTIFIER_LENGTH = 24
CATEGORICAL_SHARE = 0.5
CATEGORICAL_VALUES = 50
EMPTY_SHARE = 0.999


def null_profile(df: DataFrame) -> DataFrame:
    """(position, column, row_count, null_count, null_pct): one scan, no shuffle of data."""
    return scan_facts(nan_to_null(df)).select(
        "position",
        "column",
        "row_count",
        "null_count",
        F.round(null_share(F.col("null_count"), F.col("row_count")), 4).alias("null_pct"),
    )


def empty_columns(df: DataFrame) -> DataFrame:
    return null_profile(df).where(F.col("null_pct") >= EMPTY_SHARE)


def _logical_type() -> Column:
    """Logical type of a column: its physical kind, or for text the first reading that fits."""
    non_null = F.col("row_count") - F.col("null_count")

    def share(count: str) -> Column:
        return F.try_divide(F.col(count), non_null)

    unique_share = share("distinct_count")
    return (
        F.when(non_null == 0, "unknown")
        .when(F.col("kind").isin("boolean", "integer", "float", "date"), F.col("kind"))
        .when(
            share("numeric_count") > RECOGNISED_SHARE,
            F.when(F.col("has_fraction"), "float").otherwise("integer"),
        )
        .when(share("date_count") > RECOGNISED_SHARE, "date")
        .when(F.col("distinct_count") <= 1, "constant")
        .when(
            (F.col("kind") == "text") & (unique_share > IDENTIFIER_SHARE),
            F.when(share("chars") <= IDENTIFIER_LENGTH, "identifier").otherwise("text"),
        )
        .when((unique_share < CATEGORICAL_SHARE) | (F.col("distinct_count") <= CATEGORICAL_VALUES), "categorical")
        .otherwise("text")
    )


def _extreme(number: str, whole: str, moment: str, typed: str) -> Column:
    from_text = (
        F.when(F.col("inferred_type") == "integer", F.coalesce(F.col(whole), F.col(number).cast("decimal(38,0)")).cast("string"))
        .when(F.col("inferred_type") == "float", number_text(F.col(number)))
        .when(F.col("inferred_type") == "date", F.col(moment).cast("string"))
    )
    return F.when(F.col("kind") == "text", from_text).otherwise(F.col(typed))


def _measured(df: DataFrame, exact: bool) -> DataFrame:
    """Scan facts joined with value facts; every side has one row per column of the table."""
    df = nan_to_null(df)
    typed = typed_facts(df, exact).withColumnRenamed("distinct_count", "typed_distinct")
    joined = scan_facts(df).join(F.broadcast(typed), "column", "left")
    names = text_columns(df)
    if names:
        joined = joined.join(F.broadcast(text_facts(df, names, exact)), "column", "left")
        distinct = F.coalesce("typed_distinct", "distinct_count", F.lit(0))
    else:
        for name, kind in (("numeric_count", "bigint"), ("date_count", "bigint"), ("chars", "bigint"),
                           ("has_fraction", "boolean"), ("low_number", "double"), ("high_number", "double"),
                           ("low_whole", "decimal(38,0)"), ("high_whole", "decimal(38,0)"),
                           ("low_moment", "timestamp_ntz"), ("high_moment", "timestamp_ntz")):
            joined = joined.withColumn(name, F.lit(None).cast(kind))
        distinct = F.coalesce("typed_distinct", F.lit(0))
    return joined.withColumn("distinct_count", distinct)


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """(position, column, unique_count), nulls left out."""
    return _measured(df, exact).select("position", "column", F.col("distinct_count").alias("unique_count"))


def inferred_types(df: DataFrame, exact: bool = True) -> DataFrame:
    """(position, column, inferred_type)."""
    return _measured(df, exact).select("position", "column", _logical_type().alias("inferred_type"))


def column_profile(df: DataFrame, samples: bool = True, exact: bool = True) -> DataFrame:
    """One row per column: logical type, nulls, distinct values, sample values and range.

    `exact=False` replaces distinct counts by sketches, which leaves no shuffle that grows with
    the table; pass `samples=False` with it to skip the distinct scan behind the sample values.
    """
    df = nan_to_null(df)
    typed = _measured(df, exact).withColumn("inferred_type", _logical_type())
    profile = typed.select(
        "position",
        "column",
        "inferred_type",
        "null_count",
        F.round(null_share(F.col("null_count"), F.col("row_count")), 4).alias("null_pct"),
        F.col("distinct_count").alias("unique_count"),
        _extreme("low_number", "low_whole", "low_moment", "low").alias("min_value"),
        _extreme("high_number", "high_whole", "high_moment", "high").alias("max_value"),
    )
    if not samples:
        return profile
    drawn = profile.join(F.broadcast(sample_values(df)), "column", "left")
    none = F.array().cast("array<string>")
    return drawn.select(*profile.columns, F.coalesce("sample_values", none).alias("sample_values"))
