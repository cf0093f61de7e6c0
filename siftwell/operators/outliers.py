"""Interquartile-range fences."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import quoted
from siftwell.operators.columns import nan_to_null, numeric_columns
from siftwell.operators.detectors import OUTLIER_FENCE, OUTLIER_MIN_VALUES
from siftwell.operators.local import fixed
from siftwell.operators.quantiles import Span, quantiles, spans

Fences = dict[str, tuple[float, float]]

FENCE_SCHEMA = "position int, column string, lower double, upper double, outlier_count bigint"


def fence_of(q1: float, q3: float) -> tuple[float, float]:
    reach = OUTLIER_FENCE * (q3 - q1)
    return q1 - reach, q3 + reach


def iqr_fences(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    known: Mapping[str, Span] | None = None,
    minimum: int = OUTLIER_MIN_VALUES,
    flat: bool = False,
    **search,
) -> Fences:
    """column -> (lower, upper) for numeric columns with enough values and, unless `flat`, a non-zero range."""
    names = numeric_columns(df) if columns is None else list(columns)
    if not names:
        return {}
    df = nan_to_null(df)
    known = spans(df, names) if known is None else known
    eligible = [c for c in names if c in known and known[c].count >= minimum]
    quartiles = quantiles(df, eligible, (0.25, 0.75), known, **search)
    return {c: fence_of(q1, q3) for c, (q1, q3) in quartiles.items() if flat or q3 != q1}


def is_outside(c: Column, fence: tuple[float, float]) -> Column:
    lower, upper = fence
    return (c < F.lit(lower)) | (c > F.lit(upper))


def outlier_counts(df: DataFrame, fences: Fences) -> DataFrame:
    """(position, column, lower, upper, outlier_count): one pass over the fenced columns."""
    if not fences:
        return fixed(df.sparkSession, [], FENCE_SCHEMA)
    counts = nan_to_null(df).agg(*[F.count_if(is_outside(quoted(c), f)).alias(f"n{i}") for i, (c, f) in enumerate(fences.items())])
    rows = [
        F.struct(
            F.lit(df.columns.index(c)).alias("position"),
            F.lit(c).alias("column"),
            F.lit(lower).alias("lower"),
            F.lit(upper).alias("upper"),
            F.col(f"n{i}").alias("outlier_count"),
        )
        for i, (c, (lower, upper)) in enumerate(fences.items())
    ]
    return counts.select(F.inline(F.array(*rows)))
