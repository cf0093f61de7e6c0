"""Cleaning transforms: lazy DataFrame-to-DataFrame steps."""

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import normalize_text, parse_number_lenient, quoted, state_code
from siftwell.operators.columns import kind_of
from siftwell.operators.outliers import Fences, is_outside
from siftwell.operators.quantiles import quantiles
from siftwell.operators.values import modes, stacked

Replacements = dict[str, dict[str, str]]

# Replacements of a column that are written into the plan.
VALUES_IN_PLAN = 100


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double: text is parsed, separators dropped, the unreadable becomes null."""
    kind = kind_of(df.schema[name].dataType)
    if kind == "text":
        return parse_number_lenient(quoted(name))
    return quoted(name).try_cast("double")


def with_columns(df: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    """Replace columns in place, keeping order and any name."""
    return df.select(*[changed[c].alias(c) if c in changed else quoted(c) for c in df.columns])


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return with_columns(df, {c: as_number(df, c) for c in columns})


def medians(df: DataFrame, columns: Sequence[str], **search) -> dict[str, float]:
    """Median of each column read as a number, all columns in one search."""
    if not columns:
        return {}
    numbers = df.select(*[as_number(df, c).alias(c) for c in columns])
    return {c: m for c, (m,) in quantiles(numbers, columns, (0.5,), **search).items()}


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value of each column as text, the lowest on ties."""
    if not columns:
        return {}
    return {r["column"]: r["value"] for r in modes(df, columns).collect()}


def impute_median(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    return with_columns(df, {c: F.coalesce(as_number(df, c), F.lit(m)) for c, m in fills.items()})


def _typed(text: str, kind: T.DataType) -> Column:
    """A value from the text form in which modes are counted."""
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.lit(text))
    if isinstance(kind, T.VariantType):
        return F.parse_json(F.lit(text))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.from_json(F.lit(text), kind)
    return F.lit(text).cast(kind)


def impute_mode(df: DataFrame, fills: Mapping[str, str]) -> DataFrame:
    def filled(name: str, value: str) -> Column:
        kind = df.schema[name].dataType
        return F.coalesce(quoted(name), _typed(value, kind))

    return with_columns(df, {c: filled(c, v) for c, v in fills.items()})


def standardize_states(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return with_columns(df, {c: F.coalesce(state_code(quoted(c)), quoted(c)) for c in columns})


def variant_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, variant, canonical, n): every spelling with the most frequent one of its group."""
    counted = stacked(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    spelled = counted.withColumn("norm", normalize_text(F.col("value")))
    canonical = F.min(F.struct((-F.col("n")).alias("rank"), "value"))["value"].alias("canonical")
    groups = spelled.groupBy("column", "norm").agg(canonical, F.count("*").alias("variants"))
    several = groups.where(F.col("variants") > 1).drop("variants")
    return spelled.join(several, ["column", "norm"]).select("column", F.col("value").alias("variant"), "canonical", "n")


def variant_examples(df: DataFrame, states: Sequence[str], variants: Sequence[str], size: int = 3) -> DataFrame:
    """(column, examples): the first few replacements of each column, written out for the action's note."""
    parts = []
    if states:
        cells = stacked(df, states).distinct().withColumn("canonical", state_code(F.col("value")))
        parts.append(cells.withColumnRenamed("value", "variant"))
    if variants:
        parts.append(variant_table(df, variants).select("column", "variant", "canonical"))
    pairs = reduce(DataFrame.unionByName, parts).where("variant != canonical")
    first = Window.partitionBy("column").orderBy("variant")
    chosen = pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)
    shown = F.format_string("('%s', '%s')", "variant", "canonical")
    listed = F.array_sort(F.collect_list(F.struct("rank", shown.alias("pair"))))
    joined = F.array_join(F.transform(listed, lambda p: p["pair"]), ", ")
    return chosen.groupBy("column").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("examples"))


def standardize_variants(df: DataFrame, spellings: DataFrame, columns: Sequence[str], in_plan: int = VALUES_IN_PLAN) -> DataFrame:
    """Replace every variant of `spellings` (column, variant, canonical) in its column.

    Columns with few variants, counted before anything reaches the driver, have them written into the plan and replaced
    without a shuffle; the others are joined with the table of spellings, however long it is.
    """
    changed = spellings.where(F.col("variant") != F.col("canonical"))
    counts = {r["column"]: r["count"] for r in changed.groupBy("column").count().collect() if r["column"] in columns}
    few = [c for c, n in counts.items() if n <= in_plan]
    small: Replacements = {c: {} for c in few}
    for r in changed.where(F.col("column").isin(few)).collect() if few else []:
        small[r["column"]][r["variant"]] = r["canonical"]
    df = replace_values(df, small)
    for c in counts:
        if c not in small:
            df = replace_by_lookup(df, c, changed)
    return df


def replace_values(df: DataFrame, replacements: Replacements) -> DataFrame:
    """All replacements at once; values without one stay as they are. Small maps only."""

    def replaced(name: str, mapping: Mapping[str, str]) -> Column:
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
        c = quoted(name)
        return F.when(c.isin(*mapping), F.try_element_at(table, c)).otherwise(c)

    return with_columns(df, {c: replaced(c, m) for c, m in replacements.items() if m})


def replace_by_lookup(
    df: DataFrame, column: str, lookup: DataFrame, max_broadcast: int = 100_000, salts: int = 32, max_bytes: int = 8 << 20
) -> DataFrame:
    """Replace values through a (variant, canonical) table of any size, or through its rows for `column` if it names columns.

    A variant given several times takes the lowest canonical, so no row is ever multiplied. Broadcast only if both
    rows and bytes of the table are counted small. A larger one is joined by shuffle, with every value of the column
    spread over several salts so that no hot value lands in one task.
    """
    own = lookup.where(F.col("column") == column) if "column" in lookup.columns else lookup
    pairs = own.groupBy(F.col("variant").alias("__variant")).agg(F.min("canonical").alias("__canonical"))
    size = pairs.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("__variant") + F.octet_length("__canonical")).alias("bytes")
    ).first()
    if size["rows"] <= max_broadcast and (size["bytes"] or 0) <= max_bytes:
        joined = df.join(F.broadcast(pairs), quoted(column) == F.col("__variant"), "left")
    else:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*map(quoted, df.columns)), F.lit(salts)))
        spread = pairs.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
        joined = salted.join(
            spread, (quoted(column) == F.col("__variant")) & (salted["__salt"] == spread["__salt"]), "left"
        )
    fixed = {column: F.coalesce(F.col("__canonical"), quoted(column))}
    return joined.select(*[fixed[c].alias(c) if c in fixed else quoted(c) for c in df.columns])


def outside_any(df: DataFrame, fences: Fences) -> Column:
    """Whether a row lies outside one of the fences; without a value it does not."""
    outside = [F.coalesce(is_outside(as_number(df, name), fence), F.lit(False)) for name, fence in fences.items()]
    return reduce(Column.__or__, outside, F.lit(False))


def drop_outliers(df: DataFrame, fences: Fences) -> DataFrame:
    """Rows outside a fence removed; rows without a value there are kept."""
    return df.where(~outside_any(df, fences)) if fences else df


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for name in columns:
        df = df.where(quoted(name).isNotNull())
    return df
