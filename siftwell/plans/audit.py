"""Row-level audit of cleaning: what each action changed in a row, carried along with it, and the rows it dropped.

The record is a column of the plan that does the cleaning, so it costs no pass and no shuffle of its own.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import quoted
from siftwell.operators.local import fixed

CHANGE = "struct<column: string, old: string, new: string, action: string>"
DROPPED = "action_id string, action string, column string, row string, copies long"
_CHANGES, _OLD = "__siftwell_changes", "__siftwell_old"
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def tracked(df: DataFrame) -> DataFrame:
    """`df` with an empty record of changes in each row."""
    return df.withColumns({_CHANGES: F.array().cast(f"array<{CHANGE}>")})


def _written(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, _NESTED) else c.cast("string")


def _same(old: Column, new: Column, was: T.DataType, now: T.DataType) -> Column:
    """Equal values, or a text that already reads as the number it became."""
    if was == now:
        return _written(old, was).eqNullSafe(_written(new, now)) if isinstance(was, _NESTED) else old.eqNullSafe(new)
    return old.try_cast(now).eqNullSafe(new)


def noted(df: DataFrame, column: str, action: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `step` makes of `df`, with each value of `column` that it changed added to the record of its row."""
    after = step(df.withColumns({_OLD: quoted(column)}))
    old, new, was, now = F.col(_OLD), quoted(column), after.schema[_OLD].dataType, after.schema[column].dataType
    entry = F.struct(F.lit(column).alias("column"), _written(old, was).alias("old"), _written(new, now).alias("new"), F.lit(action).alias("action"))
    record = F.when(_same(old, new, was, now), F.col(_CHANGES)).otherwise(F.concat(_CHANGES, F.array(entry)))
    return after.withColumns({_CHANGES: record}).drop(_OLD)


def shown(df: DataFrame) -> DataFrame:
    """A tracked table with its record as the last column, named `changes` or, if that is taken, with a number."""
    name, taken = "changes", {c.lower() for c in df.columns}
    while name in taken:
        name = f"changes_{len(name)}"
    return df.withColumnRenamed(_CHANGES, name)


def untracked(df: DataFrame) -> DataFrame:
    return df.drop(_CHANGES)


def _row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[quoted(c) for c in df.columns if c != _CHANGES]), {"ignoreNullFields": "false"})


def dropped_rows(df: DataFrame, action: Row, gone: Column) -> DataFrame:
    """The rows of `df` that an action drops, as JSON."""
    about = [F.lit(action[c]).cast("string").alias(c) for c in ("action_id", "action", "column")]
    return df.where(gone).select(*about, _row(df).alias("row"), F.lit(1).cast("long").alias("copies"))


def dropped_copies(df: DataFrame, action: Row) -> DataFrame:
    """The rows of which further copies are dropped, and how many."""
    about = [F.lit(action[c]).cast("string").alias(c) for c in ("action_id", "action", "column")]
    counted = df.select(_row(df).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.select(*about, "row", (F.col("n") - 1).alias("copies"))


def no_rows(df: DataFrame) -> DataFrame:
    return fixed(df.sparkSession, [], DROPPED)
