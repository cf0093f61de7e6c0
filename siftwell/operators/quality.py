"""Quality score: completeness, uniqueness and consistency of spelling."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.columns import nan_to_null, text_columns
from siftwell.operators.duplicates import duplicate_count
from siftwell.operators.facts import scan_facts, text_facts

COMPLETENESS_WEIGHT = 0.5
UNIQUENESS_WEIGHT = 0.3
CONSISTENCY_WEIGHT = 0.2


def scored(measures: DataFrame) -> DataFrame:
    """One row with the score and its parts from (row_count, column_count, null_cells, duplicate_rows, consistency)."""
    rows = F.greatest(F.col("row_count"), F.lit(1))
    completeness = 1 - F.col("null_cells") / (rows * F.greatest(F.col("column_count"), F.lit(1)))
    uniqueness = 1 - F.col("duplicate_rows") / rows
    consistency = F.coalesce("consistency", F.lit(1.0))
    score = (
        COMPLETENESS_WEIGHT * completeness + UNIQUENESS_WEIGHT * uniqueness + CONSISTENCY_WEIGHT * consistency
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    empty = F.col("row_count") == 0
    return measures.select(
        "row_count",
        "column_count",
        F.round(completeness, 6).alias("completeness"),
        F.round(uniqueness, 6).alias("uniqueness"),
        F.round(consistency, 6).alias("consistency"),
        F.when(empty, 0.0).otherwise(F.round(bounded, 4)).alias("quality_score"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    """(row_count, column_count, completeness, uniqueness, consistency, quality_score)."""
    df = nan_to_null(df)
    cells = scan_facts(df).agg(F.max("row_count").alias("row_count"), F.sum("null_count").alias("null_cells"))
    parts = [cells, duplicate_count(df)]
    names = text_columns(df)
    if names:
        spelling = F.col("normalized_count") / F.col("distinct_count")
        parts.append(text_facts(df, names).agg(F.avg(spelling).alias("consistency")))
    # Each part is a single row; stacking and folding them spares a join.
    stacked_parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not names:
        stacked_parts = stacked_parts.withColumn("consistency", F.lit(None).cast("double"))
    folded = stacked_parts.agg(
        *[F.max(c).alias(c) for c in ("row_count", "null_cells", "duplicate_rows", "consistency")]
    )
    return scored(folded.withColumn("column_count", F.lit(len(df.columns))))
