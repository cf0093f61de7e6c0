"""Significance tests turned into ranked findings.

The data is read by a handful of fused aggregates; everything after them works on one row per test.
"""

from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.special import p_value
from siftwell.operators.columns import nan_to_null, numeric_columns
from siftwell.operators.local import collected, fixed, together
from siftwell.operators.statistics import (
    LEVEL_LIMIT,
    categorical_columns,
    correlation_t,
    describe,
    group_moments,
    group_tests,
    pair_table,
    percent_change,
    text_roles,
)

SIGNIFICANT = 0.05
HIGHLY_SIGNIFICANT = 0.01
CLEARLY_NOT = 0.2
TREND_MIN_ROWS, TREND_MIN_R = 6, 0.2
PAIR_MIN_ROWS, PAIR_MIN_R, PAIR_STRONG_R, PAIR_HIGH_R = 8, 0.3, 0.6, 0.5

FINDING_COLUMNS = (
    "rank", "finding_id", "summary", "statistical_support", "recommended_chart", "confidence",
    "related_columns", "effect_size", "p_value", "caveat",
)

TEST_SCHEMA = (
    "sequence int, kind string, x string, y string, n bigint, statistic string, stat double, df1 double, df2 double, "
    "r double, slope double, first double, last double, groups bigint, highest string, lowest string, p double"
)


@dataclass(frozen=True)
class Lineage:
    """What cleaning did to the table: rows removed as duplicates and columns changed."""

    duplicates: int = 0
    columns: tuple[str, ...] = ()

    @staticmethod
    def of(log: DataFrame | None) -> "Lineage":
        """From a cleaning log; only applied actions count. The log has a few rows per column."""
        if log is None:
            return Lineage()
        applied = log.where(F.col("status") == "approved")
        row = applied.agg(
            F.coalesce(F.sum(F.when(F.col("action") == "dropped_rows", F.col("count"))), F.lit(0)).alias("duplicates"),
            F.array_sort(F.collect_set("column")).alias("columns"),
        ).first()
        return Lineage(row["duplicates"], tuple(row["columns"]))


@dataclass(frozen=True)
class AnalysisResult:
    """Ranked findings, descriptive statistics, and the goal the caller stated."""

    findings: DataFrame
    summary_stats: DataFrame
    goal: str | None = None


def caveat(columns: Column, lineage: Lineage) -> Column:
    """Note on how cleaning touched the columns of a finding, null if it did not."""
    touched = F.array_sort(F.array_intersect(columns, F.array(*[F.lit(c) for c in lineage.columns]).cast("array<string>")))
    modified = F.when(
        F.size(touched) > 0,
        F.concat(
            F.lit("column(s) ['"),
            F.array_join(touched, "', '"),
            F.lit("'] were modified during cleaning (imputed/standardized) — worth confirming that didn't bias this result"),
        ),
    )
    # The wording of caveats.
    removed = (
        f"analysis excludes {lineage.duplicates} row(s) removed as duplicates during cleaning" if lineage.duplicates else None
    )
    return F.nullif(F.concat_ws("; ", F.lit(removed).cast("string"), modified), F.lit(""))


@dataclass(frozen=True)
class _Planned:
    """The tests that a table gives rise to, in their order."""

    date: str | None
    trends: list[str]
    pairs: list[tuple[str, str]]
    categories: list[str]
    measures: list[str]

    def listed(self) -> list[tuple[str, str, str]]:
        """(kind, x, y) of each test."""
        trends = [("trend", self.date, y) for y in self.trends]
        return trends + [("pair", x, y) for x, y in self.pairs] + [("group", x, y) for x, y in product(self.categories, self.measures)]

    def capped(self, max_trends: int | None, max_pairs: int | None, max_categories: int | None, max_measures: int | None) -> "_Planned":
        return _Planned(
            self.date, self.trends[:max_trends], self.pairs[:max_pairs], self.categories[:max_categories], self.measures[:max_measures]
        )


def _planned(df: DataFrame, max_levels: int) -> _Planned:
    numbers = numeric_columns(df)
    if not numbers:
        return _Planned(None, [], [], [], [])
    roles = text_roles(df, max_levels)
    levels = categorical_columns(df, max_levels, roles).collect()
    categories = [r["column"] for r in sorted(levels, key=lambda r: r["position"])]
    return _Planned(roles.date, numbers if roles.date else [], list(combinations(numbers, 2)), categories, numbers)


def omitted_tests(
    df: DataFrame,
    max_trends: int | None = None,
    max_pairs: int | None = None,
    max_categories: int | None = None,
    max_measures: int | None = None,
    max_levels: int = LEVEL_LIMIT,
) -> DataFrame:
    """(kind, x, y): the tests that these caps leave out of `test_statistics`; none without a cap."""
    every = _planned(nan_to_null(df), max_levels)
    made = set(every.capped(max_trends, max_pairs, max_categories, max_measures).listed())
    return fixed(df.sparkSession, [t for t in every.listed() if t not in made], "kind string, x string, y string")


def test_statistics(
    df: DataFrame,
    max_trends: int | None = None,
    max_pairs: int | None = None,
    max_categories: int | None = None,
    max_measures: int | None = None,
    p_values: bool = True,
    max_levels: int = LEVEL_LIMIT,
) -> DataFrame:
    """One row per eligible test, significant or not: trends, then pairs, then group differences.

    Every numeric column, pair and category is tested unless an argument says how many of the first ones to take. A
    category is a text column of up to `max_levels` values. `omitted_tests` lists what caps leave out.
    """
    df = nan_to_null(df)
    plan = _planned(df, max_levels).capped(max_trends, max_pairs, max_categories, max_measures)
    date, trends, pairs, categories, measures = plan.date, plan.trends, plan.pairs, plan.categories, plan.measures
    tests = fixed(df.sparkSession, [], TEST_SCHEMA).drop("p")

    if trends or pairs:
        moments = pair_table(df, pairs, date, trends)
        enough = F.when(F.col("kind") == "trend", F.col("n") >= TREND_MIN_ROWS).otherwise(F.col("n") >= PAIR_MIN_ROWS)
        eligible = moments.where(enough & F.col("r").isNotNull())
        linear = eligible.select(
            "sequence", "kind", "x", "y", "n", "r", "slope", "first", "last",
            F.lit("t").alias("statistic"),
            correlation_t(F.col("r"), F.col("n")).alias("stat"),
            (F.col("n") - 2).cast("double").alias("df1"),
        )
        tests = tests.unionByName(linear, allowMissingColumns=True)
    if categories and measures:
        order = {pair: len(trends) + len(pairs) + 1000 + i for i, pair in enumerate(product(categories, measures))}
        place = F.get(
            F.array(*[F.lit(i) for i in order.values()]),
            (F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category")) - 1) * len(measures)
            + F.array_position(F.array(*[F.lit(m) for m in measures]), F.col("measure")) - 1,
        )
        compared = group_tests(group_moments(df, categories, measures)).where(F.col("stat").isNotNull())
        grouped = compared.select(
            place.cast("int").alias("sequence"),
            F.lit("group").alias("kind"),
            F.col("category").alias("x"),
            F.col("measure").alias("y"),
            "n", "stat", "df1", "df2", "groups", "highest", "lowest",
            F.when(F.col("test") == "t-test", "t").otherwise("f").alias("statistic"),
        )
        tests = tests.unionByName(grouped, allowMissingColumns=True)
    if not p_values:
        return tests
    return tests.withColumn("p", p_value(F.col("statistic"), F.col("stat"), F.col("df1"), F.col("df2")))


def _number(pattern: str, c: Column) -> Column:
    shown = F.format_string(pattern, c)
    return F.when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(shown)


def _described(tests: DataFrame) -> DataFrame:
    """Keep what is worth reporting and put it in words."""
    # The wording of the summaries.
    kind, p, r, x, y = F.col("kind"), F.col("p"), F.col("r"), F.col("x"), F.col("y")
    related = (p < SIGNIFICANT) & (F.abs(r) >= PAIR_MIN_R)
    kept = (
        F.when(kind == "trend", (p < SIGNIFICANT) & (F.abs(r) >= TREND_MIN_R))
        .when(kind == "group", p < SIGNIFICANT)
        .otherwise(p.isNotNull())
    )
    change = percent_change(F.col("first"), F.col("last"))
    change_text = F.when(change.isNull(), "").otherwise(F.format_string(" (%+.1f%% over the observed period)", change))
    direction = F.when(F.col("slope") > 0, "increased").otherwise("decreased")
    strength = F.when(F.abs(r) >= PAIR_STRONG_R, "strong").otherwise("moderate")
    sign = F.when(r > 0, "positive").otherwise("negative")
    summary = (
        F.when(kind == "trend", F.format_string("%s has %s over time%s, tracked by %s.", y, direction, change_text, x))
        .when(
            kind == "group",
            F.format_string(
                "%s differs significantly across %s groups — '%s' averages highest, '%s' lowest.", y, x, "highest", "lowest"
            ),
        )
        .when(related, F.format_string("%s and %s show a %s %s correlation.", x, y, strength, sign))
        .otherwise(F.format_string("%s shows no significant correlation with %s.", x, y))
    )
    p_text = _number("%.4f", p)
    support = (
        F.when(kind == "trend", F.format_string("linear trend: r=%s, p=%s, n=%d", _number("%.2f", r), p_text, "n"))
        .when(kind == "pair", F.format_string("pearson r=%s, p=%s, n=%d", _number("%.2f", r), p_text, "n"))
        .otherwise(
            F.format_string(
                "%s: stat=%s, p=%s, groups=%d",
                F.when(F.col("statistic") == "t", "t-test").otherwise("one-way ANOVA"),
                _number("%.2f", F.col("stat")),
                p_text,
                "groups",
            )
        )
    )
    chart = (
        F.when(kind == "trend", "line")
        .when(kind == "group", "grouped_bar")
        .when(related, "scatter_with_trendline")
        .otherwise("none")
    )
    firm = (
        F.when(kind != "pair", p < HIGHLY_SIGNIFICANT)
        .when(related, (p < HIGHLY_SIGNIFICANT) & (F.abs(r) >= PAIR_HIGH_R))
        .otherwise(p >= CLEARLY_NOT)
    )
    return tests.where(kept).select(
        "sequence",
        F.concat(F.lit("f_"), F.substring(F.sha2(F.concat_ws("|", kind, x, y), 256), 1, 8)).alias("finding_id"),
        summary.alias("summary"),
        support.alias("statistical_support"),
        chart.alias("recommended_chart"),
        F.when(firm, "high").otherwise("medium").alias("confidence"),
        F.array(x, y).alias("related_columns"),
        F.round(r, 4).alias("effect_size"),
        F.round(p, 6).alias("p_value"),
    )


def ranked(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Most confident first, then by p-value, then in the order the tests were made."""
    confidence = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("confidence"))
    order = (confidence, F.coalesce("p_value", F.lit(1.0)), F.col("sequence"))
    top = findings if limit is None else findings.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def findings_of(df: DataFrame, log: DataFrame | None = None, limit: int | None = None, **caps) -> DataFrame:
    """All findings of a table in order, or the first `limit`, as a lazy DataFrame; `caps` are those of `test_statistics`."""
    top = ranked(_described(test_statistics(df, **caps)), limit)
    noted = top.withColumn("caveat", caveat(F.col("related_columns"), Lineage.of(log)))
    return noted.select(*FINDING_COLUMNS).orderBy("rank")


def analyze(df: DataFrame, log: DataFrame | None = None, goal: str | None = None, **caps) -> AnalysisResult:
    """Findings and descriptive statistics. There is at most one finding per test, so they are fixed here once."""
    found, described = together(df.sparkSession, lambda: collected(findings_of(df, log, **caps)), lambda: describe(df))
    return AnalysisResult(found, described, goal)
