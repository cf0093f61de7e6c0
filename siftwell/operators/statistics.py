"""Descriptive statistics, group summaries and the moments behind each significance test."""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from itertools import combinations
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import moment_literal, parse_date, quoted, whole_days
from siftwell.operators.columns import nan_to_null, numeric_columns, temporal_columns, text_columns
from siftwell.operators.gram import SUMS, pair_sums
from siftwell.operators.local import fixed
from siftwell.operators.quantiles import Span, quantiles
from siftwell.operators.values import stacked

LEVEL_LIMIT = 12
DATE_SHARE = 0.9
MIN_GROUP_ROWS = 3
# Spark generates code for aggregates of up to a hundred columns.
AGGREGATE_WIDTH = 96
# Share of a sum of squares that rounding may leave of a difference that is none.
ROUNDING = 1e-12
# Columns whose products one task holds at a time: some 50 bytes for each two of them.
GRAM_COLUMNS = 1_024

DESCRIPTION_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
)
PAIR_SCHEMA = (
    "sequence int, kind string, x string, y string, n bigint, r double, slope double, intercept double, "
    "low_x double, high_x double, first double, last double"
)


def _double(name: str) -> Column:
    return quoted(name).cast("double")


def describe(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None, **search) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max), four decimals, for all numeric columns or the first `limit`."""
    df = nan_to_null(df)
    names = (numeric_columns(df) if columns is None else list(columns))[:limit]
    if not names:
        return fixed(df.sparkSession, [], DESCRIPTION_SCHEMA)
    aggregates = [
        make(_double(c)).alias(f"{name}{i}")
        for i, c in enumerate(names)
        for name, make in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    moments = df.agg(*aggregates).first()
    known = {
        c: Span(moments[f"count{i}"], moments[f"min{i}"], moments[f"max{i}"])
        for i, c in enumerate(names)
        if moments[f"count{i}"]
    }
    at = quantiles(df, names, (0.25, 0.5, 0.75), known, **search)
    rows = [
        (c, *[moments[f"{name}{i}"] for name in ("count", "mean", "std", "min")], *at.get(c, (None,) * 3), moments[f"max{i}"])
        for i, c in enumerate(names)
    ]
    table = fixed(df.sparkSession, rows, DESCRIPTION_SCHEMA)
    return table.select("column", "count", *[(F.round(c, 4) + 0.0).alias(c) for c in table.columns[2:]])


def group_means(df: DataFrame, category: str, measure: str) -> DataFrame:
    """(level, mean, n) over rows with both values, highest mean first."""
    pair = nan_to_null(df).where(quoted(category).isNotNull() & quoted(measure).isNotNull())
    grouped = pair.groupBy(quoted(category).alias("level")).agg(F.avg(_double(measure)).alias("mean"), F.count("*").alias("n"))
    return grouped.orderBy(F.desc("mean"), "level")


@dataclass(frozen=True)
class TextRoles:
    """The date column of a table, and the text columns that may be categories."""

    date: str | None
    likely: tuple[str, ...]


def text_roles(df: DataFrame, max_levels: int = LEVEL_LIMIT, dates: bool = True) -> TextRoles:
    """One scan of the text columns.

    The date column is the first date or timestamp column, else the first text column that reads as
    dates in over nine of ten rows. Likely categories are those a sketch does not rule out: near-unique
    text is never shuffled to learn that it is not a category.
    """
    stored, names = temporal_columns(df), text_columns(df)
    date = stored[0] if stored else None
    if not names:
        return TextRoles(date, ())
    aggregates = [F.approx_count_distinct(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)]
    read = dates and date is None
    if read:
        aggregates += [F.try_divide(F.count(parse_date(quoted(c))), F.count("*")).alias(f"s{i}") for i, c in enumerate(names)]
    row = df.agg(*aggregates).first()
    likely = tuple(c for i, c in enumerate(names) if 1 <= row[f"n{i}"] <= 10 * max_levels)
    if read:
        date = next((c for i, c in enumerate(names) if (row[f"s{i}"] or 0) > DATE_SHARE), None)
    return TextRoles(date, likely)


def categorical_columns(df: DataFrame, max_levels: int = LEVEL_LIMIT, roles: TextRoles | None = None) -> DataFrame:
    """(position, column, levels) of the text columns with 2 to `max_levels` distinct values, counted exactly."""
    likely = (roles or text_roles(df, max_levels, dates=False)).likely
    if not likely:
        return fixed(df.sparkSession, [], "position int, column string, levels bigint")
    position = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column")) - 1
    levels = stacked(df, likely).distinct().groupBy("column").agg(F.count("*").alias("levels"))
    return levels.where(F.col("levels").between(2, max_levels)).select(position.cast("int").alias("position"), "column", "levels")


def date_column(df: DataFrame) -> str | None:
    stored = temporal_columns(df)
    return stored[0] if stored else text_roles(df).date


def moment_of(df: DataFrame, column: str) -> Column:
    """The column as timestamp without zone, text parsed."""
    if column in text_columns(df):
        return parse_date(quoted(column))
    return quoted(column).cast("timestamp_ntz")


@dataclass(frozen=True)
class Centre:
    """Mean of a measure, whether it has gaps, and the first and last moment at which it has a value."""

    mean: float | None
    gaps: bool = True
    start: datetime | None = None
    end: datetime | None = None


def centres(df: DataFrame, measures: Sequence[str], date: str | None = None, dated: Sequence[str] = ()) -> dict[str, Centre]:
    """Centre of each measure in one scan, with dates (under the name of the date column, their gaps) for those in `dated`."""
    if not measures:
        return {}
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(measures):
        aggregates += [F.avg(_double(c)).alias(f"mean{i}"), F.count(quoted(c)).alias(f"n{i}")]
    if date is not None:
        df = df.withColumn("__moment", moment_of(df, date))
        aggregates.append(F.count("__moment").alias("moments"))
        for i, c in enumerate(measures):
            if c in dated:
                moment = F.when(quoted(c).isNotNull(), F.col("__moment"))
                aggregates += [F.min(moment).alias(f"start{i}"), F.max(moment).alias(f"end{i}")]
    row = df.agg(*aggregates).first().asDict()
    found = {
        c: Centre(row[f"mean{i}"], row[f"n{i}"] < row["rows"], row.get(f"start{i}"), row.get(f"end{i}"))
        for i, c in enumerate(measures)
    }
    if date is not None:
        found[date] = Centre(None, row["moments"] < row["rows"])
    return found


@dataclass(frozen=True)
class _Test:
    """One regression: expressions of x and y, names that tell equal expressions apart from others, and offsets."""

    kind: str
    x: str
    y: str
    x_key: str
    x_value: Column
    y_value: Column
    x_offset: float
    y_offset: float
    gaps: bool
    first: tuple[str, Column]
    last: tuple[str, Column]

    def sums(self) -> dict[str, tuple[str, Column]]:
        """Field -> (key, aggregate). Without gaps, tests of the same column share its sums."""
        x, y = self.x_value, self.y_value
        both = f" with {self.x_key} and {self.y}" if self.gaps else ""

        present = x.isNotNull() & y.isNotNull()

        def kept(c: Column) -> Column:
            return F.when(present, c) if self.gaps else c

        fields = {"n": (f"n{both}", F.count(kept(x)))}
        for side, key, c in (("x", self.x_key, x), ("y", self.y, y)):
            fields[f"sum_{side}"] = (f"sum {key}{both}", F.sum(kept(c)))
            fields[f"sum_{side}{side}"] = (f"squares {key}{both}", F.sum(kept(c * c)))
            fields[f"low_{side}"] = (f"low {key}{both}", F.min(kept(c)))
            fields[f"high_{side}"] = (f"high {key}{both}", F.max(kept(c)))
        fields["sum_xy"] = (f"products {self.x_key} and {self.y}", F.sum(x * y))
        return fields | {"first": self.first, "last": self.last}


def pair_table(
    df: DataFrame, pairs: Sequence[tuple[str, str]], date: str | None = None, trends: Sequence[str] = ()
) -> DataFrame:
    """Moments of every trend and correlation test, one row per test.

    Columns: sequence, kind, x, y, n, r, slope, intercept, low_x, high_x, first, last. One scan finds the
    centres; a second one takes plain sums of the centred values, which is accurate and stays within
    generated code. Sums are shared between tests; tables with gaps need sums of their own for each
    pair. Where one aggregate would get too wide, the pairs' sums come from products of matrices instead, in one scan for
    up to GRAM_COLUMNS columns; low and high are null for those. No rows of the table are shuffled.
    """
    measures = list(dict.fromkeys([*trends, *[c for pair in pairs for c in pair]]))
    middle = centres(df, measures, date, trends)
    dated = [c for c in trends if middle[c].start is not None]
    if date is not None and dated:
        df = df.withColumn("__moment", moment_of(df, date))

    def centred(name: str) -> Column:
        return _double(name) - F.lit(middle[name].mean)

    nothing = ("nothing", F.max(F.lit(None).cast("double")))
    tests = []
    for y in dated:
        moment, start, end = F.col("__moment"), moment_literal(middle[y].start), moment_literal(middle[y].end)
        half_span = (middle[y].end - middle[y].start).days / 2
        days = whole_days(start, moment).cast("double") - half_span
        first = (f"first {y}", F.min(F.when(moment == start, _double(y))))
        last = (f"last {y}", F.max(F.when(moment == end, _double(y))))
        gaps = middle[y].gaps or middle[date].gaps
        key = f"days from {middle[y].start}"
        tests.append(_Test("trend", date, y, key, days, centred(y), half_span, middle[y].mean, gaps, first, last))
    known = [(x, y) for x, y in pairs if middle[x].mean is not None and middle[y].mean is not None]
    width = 5 * len({c for pair in known for c in pair}) + sum(11 if middle[x].gaps or middle[y].gaps else 1 for x, y in known)
    wide = {}
    for k, (x, y) in enumerate(known, len(tests)):
        # Columns that hold infinities have no centre to be products of.
        if width > AGGREGATE_WIDTH and isfinite(middle[x].mean) and isfinite(middle[y].mean):
            wide[k] = (x, y)
            continue
        gaps = middle[x].gaps or middle[y].gaps
        values = (centred(x), centred(y), middle[x].mean, middle[y].mean)
        tests.append(_Test("pair", x, y, x, *values, gaps, nothing, nothing))
    if not tests and not wide:
        return fixed(df.sparkSession, [], PAIR_SCHEMA)
    places = [k for k in range(len(tests) + len(wide)) if k not in wide]
    parts = [_summed(df, batch) for batch in _batches(list(zip(places, tests)))]
    if wide:
        parts.append(_multiplied(df, wide, {c: middle[c].mean for pair in wide.values() for c in pair}))
    sums = reduce(DataFrame.unionByName, parts)
    return sums.where(F.col("n") > 0).select(*_regression())


Sums = dict[str, tuple[str, Column]]


def _batches(tests: Sequence[tuple[int, _Test]]) -> list[list[tuple[int, _Test, Sums]]]:
    """Numbered tests with their sums, grouped so that each group needs a bounded number of distinct sums."""
    batches: list[list[tuple[int, _Test, Sums]]] = []
    keys: set[str] = set()
    for i, test in tests:
        sums = test.sums()
        needed = {key for key, _ in sums.values()}
        if not batches or len(keys | needed) > AGGREGATE_WIDTH:
            batches.append([])
            keys = set()
        keys |= needed
        batches[-1].append((i, test, sums))
    return batches


def _summed(df: DataFrame, batch: Sequence[tuple[int, _Test, Sums]]) -> DataFrame:
    """One row of sums per test from one ungrouped aggregate."""
    names: dict[str, str] = {}
    aggregates, rows = [], []
    for i, test, sums in batch:
        fields = []
        for field, (key, aggregate) in sums.items():
            if key not in names:
                names[key] = f"a{len(names)}"
                aggregates.append(aggregate.alias(names[key]))
            fields.append(F.col(names[key]).alias(field))
        labels = {"sequence": i, "kind": test.kind, "x": test.x, "y": test.y, "x0": float(test.x_offset), "y0": float(test.y_offset)}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in labels.items()], *fields))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _multiplied(df: DataFrame, pairs: dict[int, tuple[str, str]], middle: dict[str, float]) -> DataFrame:
    """The rows of `_summed` for numbered pairs of columns with finite means, from products of matrices."""
    place = {c: k for k, c in enumerate(middle)}
    values = {c: _double(c) - F.lit(mean) for c, mean in middle.items()}
    half = GRAM_COLUMNS // 2
    blocks = [range(k, min(k + half, len(values))) for k in range(0, len(values), half)]
    columns, parts = list(values.values()), []
    # Two blocks of columns at a time; all pairs within a block come with the first scan that reads it.
    for a, b in list(combinations(range(len(blocks)), 2)) or [(0, 0)]:
        here = [*blocks[a], *(blocks[b] if b != a else ())]
        sums = pair_sums(df, [columns[k] for k in here])
        if len(blocks) > 2:
            number = F.array(*map(F.lit, here))
            sums = sums.withColumns({"i": F.get(number, "i"), "j": F.get(number, "j")})
            within = lambda c, k: F.col(c).between(blocks[k].start, blocks[k].stop - 1)
            own = (within("i", a) & (within("j", b) | (F.lit(b == a + 1) & within("j", a))))
            last = F.lit(a == len(blocks) - 2) & within("i", b) & within("j", b)
            sums = sums.where(own | last)
        parts.append(sums)
    wanted = [
        (k, "pair", x, y, middle[x], middle[y], min(place[x], place[y]), max(place[x], place[y]), place[x] > place[y])
        for k, (x, y) in pairs.items()
    ]
    labels = "sequence int, kind string, x string, y string, x0 double, y0 double, i int, j int, swapped boolean"
    # As many rows as there are tests.
    found = reduce(DataFrame.union, parts).join(fixed(df.sparkSession, wanted, labels), ["i", "j"])

    def side(name: str) -> Column:
        other = name.translate(str.maketrans("xy", "yx")) if name != "sum_xy" else name
        return F.when(F.col("swapped"), F.col(other)).otherwise(F.col(name)).alias(name)

    nothing = F.lit(None).cast("double")
    return found.select(
        "sequence", "kind", "x", "y", "x0", "y0", "n", *[side(c) for c in SUMS[1:]],
        *[nothing.alias(c) for c in ("low_x", "high_x", "low_y", "high_y", "first", "last")],
    )


def _regression() -> list[Column]:
    """The columns of the pair table from sums of centred values."""
    n = F.col("n")
    sxx = F.col("sum_xx") - F.col("sum_x") * F.col("sum_x") / n
    syy = F.col("sum_yy") - F.col("sum_y") * F.col("sum_y") / n
    sxy = F.col("sum_xy") - F.col("sum_x") * F.col("sum_y") / n
    # Without limits, what cancellation leaves of a constant is told from variation by its size.
    x_varies = F.coalesce((F.col("low_x") < F.col("high_x")) & (sxx > 0), sxx > ROUNDING * F.col("sum_xx"))
    y_varies = F.coalesce((F.col("low_y") < F.col("high_y")) & (syy > 0), syy > ROUNDING * F.col("sum_yy"))
    slope = F.when(x_varies, F.try_divide(sxy, sxx))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy))))
    level = F.col("sum_y") / n + F.col("y0")
    return [
        F.col("sequence"),
        F.col("kind"),
        F.col("x"),
        F.col("y"),
        n,
        F.when(x_varies & y_varies, r).alias("r"),
        slope.alias("slope"),
        (level - slope * (F.col("sum_x") / n + F.col("x0"))).alias("intercept"),
        (F.col("low_x") + F.col("x0")).alias("low_x"),
        (F.col("high_x") + F.col("x0")).alias("high_x"),
        F.col("first"),
        F.col("last"),
    ]


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of r; infinite for a perfect fit."""
    rest = 1 - r * r
    return F.when(r.isNull(), None).when(rest <= 0, float("inf")).otherwise(r * F.sqrt((n - 2) / F.when(rest > 0, rest)))


def percent_change(first: Column, last: Column) -> Column:
    """Change from the first to the last value relative to the size of the first, null from zero."""
    return F.round(F.try_divide(last - first, F.abs(F.nullif(first, F.lit(0.0)))) * 100, 1)


def group_moments(df: DataFrame, categories: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(category, measure, level, n, mean, variance): every category crossed with every measure.

    One pass: rows are laid out once per category and combined per level before the shuffle, so what
    moves is one row of moments per task and level.
    """
    names = [f"m{j}" for j in range(len(measures))]
    slots = [f"g{i}" for i in range(len(categories))]
    numbers = [_double(m).alias(name) for m, name in zip(measures, names)]
    levels = [quoted(c).alias(slot) for c, slot in zip(categories, slots)]
    long = df.select(*numbers, *levels).unpivot(names, slots, "slot", "level")
    moments = [
        make(F.col(m)).alias(f"{stat}_{m}")
        for m in names
        for stat, make in (("n", F.count), ("mean", F.avg), ("variance", F.var_samp))
    ]
    grouped = long.where(F.col("level").isNotNull()).groupBy("slot", "level").agg(*moments)
    category = F.get(F.array(*[F.lit(c) for c in categories]), F.substring("slot", 2, 9).cast("int"))
    rows = F.array(
        *[
            F.struct(
                F.lit(measure).alias("measure"),
                F.col(f"n_{m}").alias("n"),
                F.col(f"mean_{m}").alias("mean"),
                F.col(f"variance_{m}").alias("variance"),
            )
            for measure, m in zip(measures, names)
        ]
    )
    flat = grouped.select(category.alias("category"), "level", F.inline(rows)).where(F.col("n") > 0)
    return flat.select("category", "measure", "level", "n", "mean", "variance")


def group_tests(moments: DataFrame) -> DataFrame:
    """Welch's t for two groups, one-way ANOVA for more, from group moments.

    (category, measure, test, groups, n, stat, df1, df2, highest, lowest). Groups under three rows stay out
    of the test but count for the highest and lowest mean. Without spread within the groups the statistic
    is infinite if the means differ and undefined if they do not.
    """
    per_test = Window.partitionBy("category", "measure")
    tested = F.col("n") >= MIN_GROUP_ROWS
    size, mean, variance = (F.when(tested, F.col(c)) for c in ("n", "mean", "variance"))
    grand = F.sum(size * mean).over(per_test) / F.sum(size).over(per_test)
    error = variance / size
    summed = (
        moments.withColumn("grand", grand)
        .groupBy("category", "measure")
        .agg(
            F.count(size).alias("groups"),
            F.sum(size).alias("n"),
            F.sum(size * (mean - F.col("grand")) * (mean - F.col("grand"))).alias("between"),
            F.sum((size - 1) * variance).alias("within"),
            F.sum(error).alias("error"),
            F.sum(error * error / (size - 1)).alias("error_spread"),
            F.min(mean).alias("low_mean"),
            F.max(mean).alias("high_mean"),
            F.min(F.when(tested, F.struct("level", "mean")))["mean"].alias("first_mean"),
            F.max(F.when(tested, F.struct("level", "mean")))["mean"].alias("last_mean"),
            F.max(F.struct("mean", "level"))["level"].alias("highest"),
            F.min(F.struct("mean", "level"))["level"].alias("lowest"),
        )
    )
    two, differ = F.col("groups") == 2, F.col("low_mean") < F.col("high_mean")
    gap = F.col("first_mean") - F.col("last_mean")
    t = F.when(F.col("error") > 0, gap / F.sqrt("error")).when(differ, F.signum(gap) * float("inf"))
    f = F.when(
        F.col("within") > 0,
        (F.col("between") / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups"))),
    ).when(differ, float("inf"))
    welch_df = F.try_divide(F.col("error") * F.col("error"), F.col("error_spread"))
    return summed.where(F.col("groups") >= 2).select(
        "category",
        "measure",
        F.when(two, "t-test").otherwise("one-way ANOVA").alias("test"),
        "groups",
        "n",
        F.when(two, t).otherwise(f).alias("stat"),
        F.when(two, welch_df).otherwise((F.col("groups") - 1).cast("double")).alias("df1"),
        F.when(~two, (F.col("n") - F.col("groups")).cast("double")).alias("df2"),
        "highest",
        "lowest",
    )
