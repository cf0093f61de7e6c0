"""Data-quality detectors: each turns per-column facts into proposed cleaning actions.

A detector reads a facts table (one row per column) and returns action rows; it never reads or
changes the data itself. `stage` and `position` fix the order in which proposals are listed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import short_decimal
from siftwell.operators.facts import null_share

SPARSE_SHARE = 0.5
SAFE_IMPUTE_SHARE = 0.15
NUMERIC_TEXT_SHARE = 0.9
STATE_SHARE = 0.8
OUTLIER_FENCE = 1.5
OUTLIER_MIN_VALUES = 8

# The wording of reasons and notes in the detectors below, and the names of actions and methods.

ACTION_COLUMNS = (
    "action_id", "action", "column", "reason", "count", "method", "note", "severity", "status", "rows_affected",
)


def proposals(
    facts: DataFrame,
    stage: int,
    action: str | Column,
    reason: Column,
    count: Column,
    severity: str | Column = "safe",
    method: str | Column | None = None,
    note: str | Column | None = None,
    rows_affected: Column | None = None,
) -> DataFrame:
    """One action for each row of `facts`, which has at least position and column; lower stages are listed first."""

    def text(c: str | Column | None) -> Column:
        return c if isinstance(c, Column) else F.lit(c).cast("string")

    count = count.cast("bigint")
    identity = F.concat_ws("|", text(action), F.col("column"), text(method))
    return facts.select(
        F.lit(stage).alias("stage"),
        "position",
        F.concat(F.lit("act_"), F.substring(F.sha2(identity, 256), 1, 8)).alias("action_id"),
        text(action).alias("action"),
        "column",
        reason.alias("reason"),
        count.alias("count"),
        text(method).alias("method"),
        text(note).alias("note"),
        text(severity).alias("severity"),
        F.lit("proposed").alias("status"),
        (count if rows_affected is None else rows_affected.cast("bigint")).alias("rows_affected"),
    )


def detect_duplicates(duplicates: DataFrame) -> DataFrame:
    """From the one-row (duplicate_rows) table."""
    table = duplicates.where(F.col("duplicate_rows") > 0).select(
        F.lit(-1).alias("position"), F.lit(None).cast("string").alias("column"), "duplicate_rows"
    )
    return proposals(
        table,
        1,
        "dropped_rows",
        F.lit("exact duplicate records"),
        F.col("duplicate_rows"),
        note="Rows fully identical across all columns.",
    )


def detect_missing(facts: DataFrame) -> DataFrame:
    """Sparse columns are flagged, numeric ones get a median and the others a mode."""
    share = null_share(F.col("null_count"), F.col("row_count"))
    non_null = F.col("row_count") - F.col("null_count")
    numeric = F.col("kind").isin("integer", "float") | F.coalesce(
        F.col("lenient_count") / F.nullif(non_null, F.lit(0)) > NUMERIC_TEXT_SHARE, F.lit(False)
    )
    sparse = share >= SPARSE_SHARE
    percent = F.round(share * 100, 1).cast("string")
    reason = (
        F.when(sparse, F.concat(percent, F.lit("% missing — too sparse to safely impute")))
        .when(numeric, F.concat(percent, F.lit("% missing numeric values")))
        .otherwise(F.concat(percent, F.lit("% missing categorical/text values")))
    )
    note = (
        F.when(
            sparse,
            "Recommend manual review: consider dropping the column or sourcing the data rather than imputing.",
        )
        .when(numeric, "Median chosen over mean to reduce outlier sensitivity.")
        .otherwise("Most frequent value used as fill.")
    )
    return proposals(
        facts.where(F.col("null_count") > 0),
        2,
        F.when(sparse, "flagged_not_dropped").otherwise("imputed"),
        reason,
        F.col("null_count"),
        severity=F.when(~sparse & (share <= SAFE_IMPUTE_SHARE), "safe").otherwise("review"),
        method=F.when(sparse, None).when(numeric, "median").otherwise("mode"),
        note=note,
    )


def detect_numeric_text(facts: DataFrame) -> DataFrame:
    """Text columns in which more than nine in ten values are numbers."""
    numbers = facts.where(
        (F.col("kind") == "text") & (F.col("lenient_count") / F.nullif("non_null", F.lit(0)) > NUMERIC_TEXT_SHARE)
    )
    return proposals(
        numbers,
        3,
        "coerced_type",
        F.lit("numeric values stored as text"),
        F.col("non_null"),
        method="to_numeric",
        note="Thousands separators stripped before coercion.",
    )


def is_state_column() -> Column:
    """At least four in five rows read as a state, in some spelling other than the code."""
    hit_share = F.col("state_count") / F.nullif("non_null", F.lit(0))
    return (F.col("kind") == "text") & (hit_share >= STATE_SHARE) & (F.col("state_variants") > 0)


def has_case_variants(most_values: int | None = None) -> Column:
    """Some values share a normalised form; with `most_values`, only in columns of no more distinct values."""
    some = (F.col("kind") == "text") & (F.col("normalized_count") < F.col("distinct_count"))
    return some if most_values is None else some & (F.col("distinct_count") <= most_values)


def detect_state_variants(facts: DataFrame) -> DataFrame:
    """Columns of US states written in more ways than the two-letter code."""
    return proposals(
        facts.where(is_state_column()),
        4,
        "standardized",
        F.lit("US state names/abbreviations recognized as variants of the same value"),
        F.col("state_variants"),
        method="us_state_canonicalize",
        note=F.concat(F.lit("e.g. consolidating "), F.col("examples"), F.lit(" into 2-letter codes")),
        rows_affected=F.col("state_variant_rows"),
    )


def detect_case_variants(facts: DataFrame, most_values: int | None = None) -> DataFrame:
    """Values that differ only in case or surrounding whitespace; state columns are left to their own detector."""
    return proposals(
        facts.where(has_case_variants(most_values) & ~F.coalesce(is_state_column(), F.lit(False))),
        4,
        "standardized",
        F.lit("case/whitespace variants of the same value"),
        F.col("distinct_count") - F.col("normalized_count"),
        method="canonicalize",
        note=F.concat(F.lit("e.g. consolidating "), F.col("examples")),
        rows_affected=F.col("variant_rows"),
    )


def detect_outliers(fences: DataFrame) -> DataFrame:
    """From (position, column, lower, upper, outlier_count)."""
    bounds = F.concat(F.lit("["), short_decimal(F.col("lower")), F.lit(", "), short_decimal(F.col("upper")), F.lit("]"))
    return proposals(
        fences.where(F.col("outlier_count") > 0),
        5,
        "flagged_not_dropped",
        F.concat(F.col("outlier_count").cast("string"), F.lit(" value(s) outside IQR bounds "), bounds),
        F.col("outlier_count"),
        severity="review",
        method="iqr",
        note="Retained by default — extreme values are sometimes the most important data points. "
        "Approve to remove instead.",
    )
