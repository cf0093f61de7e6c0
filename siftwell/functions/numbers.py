"""Text to number, and number to text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's own cast also takes "5d", "5f", "NaN" and "Infinity"; this shape does not.
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(c: Column) -> Column:
    """Number written in the text, null where it is anything else."""
    return F.when(c.rlike(NUMBER_SHAPE), c.try_cast("double"))


def parse_number_lenient(c: Column) -> Column:
    """Like parse_number, with thousands separators dropped first."""
    return parse_number(F.translate(c, ",", ""))


def has_fraction(c: Column) -> Column:
    return c % 1 != 0


def number_text(c: Column) -> Column:
    """A double in plain notation: 42.0, 0.25, 12345678.9; very large and very small ones as 1.0E20."""
    size = F.abs(c)
    # Wide enough for every digit of a double of that size.
    decimal = F.when(size < 1, c.cast("string").try_cast("decimal(38,34)").cast("string")).otherwise(
        c.cast("string").try_cast("decimal(38,20)").cast("string")
    )
    plain = F.regexp_replace(F.regexp_replace(decimal, r"0+$", ""), r"\.$", ".0")
    return F.coalesce(F.when((size >= 1e-15) & (size < 1e15), plain), c.cast("string"))


def short_decimal(c: Column, places: int = 2) -> Column:
    """Rounded to `places`, trailing zeros dropped but one decimal kept: 7.05, 7.1, 7.0."""
    fixed = F.round(c, places).try_cast(f"decimal(38,{places})").cast("string")
    return F.coalesce(F.regexp_replace(fixed, r"(\.\d+?)0*$", "$1"), F.round(c, places).cast("string"))
