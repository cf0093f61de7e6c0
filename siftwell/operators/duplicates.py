"""Exact duplicate rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import quoted
from siftwell.operators.columns import kind_of
from siftwell.storage import staged

# Tables up to this size are deduplicated by one plain shuffle of their rows.
PLAIN_ROWS = 20_000_000
# Fingerprints that repeat are broadcast up to this many (16 bytes each).
BROADCAST_FINGERPRINTS = 1_000_000


def _holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return True
    if isinstance(data_type, T.ArrayType):
        return _holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_holds_map(f.dataType) for f in data_type)
    return False


def _comparable(field: T.StructField) -> Column:
    """The column itself, or for maps, which Spark cannot group by, a form that can be compared."""
    c = quoted(field.name)
    if isinstance(field.dataType, T.MapType) and not _holds_map(field.dataType.valueType):
        return F.array_sort(F.map_entries(c))
    return F.to_json(c) if _holds_map(field.dataType) else c


def fingerprint(df: DataFrame) -> list[Column]:
    """Two independently seeded 64-bit hashes of the whole row.

    Equal rows always agree. Different ones among n agree with a probability of about n^2 / 2^129:
    a few in 10^15 for a trillion rows. Spark's hash skips nulls, so where they stand is hashed as well.
    """
    inputs = []
    for field in df.schema:
        c = _comparable(field)
        if kind_of(field.dataType) == "nested":
            c = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        inputs.append(c)
        if field.nullable:
            inputs.append(quoted(field.name).isNull())
    return [F.xxhash64(F.lit(seed), *inputs).alias(f"__h{seed}") for seed in (1, 2)]


def fingerprint_counts(df: DataFrame) -> DataFrame:
    """(__h1, __h2, copies): what is shuffled per row does not depend on the width of the table."""
    return df.select(*fingerprint(df)).groupBy("__h1", "__h2").agg(F.count("*").alias("copies"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """(duplicate_rows): rows beyond the first of each set of identical rows; nulls count as equal."""
    extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return fingerprint_counts(df).agg(extra.cast("bigint").alias("duplicate_rows"))


def _distinct(df: DataFrame) -> DataFrame:
    maps = [field for field in df.schema if _holds_map(field.dataType)]
    if not maps:
        return df.dropDuplicates()
    keyed = df.withColumns({f"__key_{i}": _comparable(field) for i, field in enumerate(maps)})
    plain = [f.name for f in df.schema if f not in maps]
    return keyed.dropDuplicates(plain + [f"__key_{i}" for i in range(len(maps))]).select(*map(quoted, df.columns))


def drop_duplicate_rows(
    df: DataFrame,
    row_count: int | None = None,
    plain_rows: int = PLAIN_ROWS,
    broadcast_fingerprints: int = BROADCAST_FINGERPRINTS,
) -> DataFrame:
    """One row of each set of identical rows, decided on the full rows.

    For a table known to be large, the fingerprints that occur more than once are found first. Rows
    with any other fingerprint are unique and stay where they are; only the rest is shuffled whole. If
    too many fingerprints repeat to be broadcast, all rows are shuffled.
    """
    if row_count is None or row_count <= plain_rows:
        return _distinct(df)
    repeated = staged(fingerprint_counts(df).where(F.col("copies") > 1).select("__h1", "__h2"))
    if repeated.count() > broadcast_fingerprints:
        return _distinct(df)
    first, second = fingerprint(df)
    marked = df.select("*", first, second)
    keys = ["__h1", "__h2"]
    single = marked.join(F.broadcast(repeated), keys, "left_anti").select(*map(quoted, df.columns))
    several = marked.join(F.broadcast(repeated), keys, "left_semi").select(*map(quoted, df.columns))
    return single.unionByName(_distinct(several))
