"""Column selection by physical type."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import quoted

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(data_type: T.DataType) -> str:
    """text, integer, float, date, boolean or nested."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, INTEGRAL):
        return "integer"
    if isinstance(data_type, FRACTIONAL):
        return "float"
    if isinstance(data_type, TEMPORAL):
        return "date"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "nested"


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [field.name for field in df.schema if kind_of(field.dataType) in kinds]


def text_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "text")


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "integer", "float")


def temporal_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "date")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number is missing; Spark's aggregates would otherwise count it and spread it."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not doubles:
        return df
    return df.select(
        *[F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in doubles else quoted(c) for c in df.columns]
    )
