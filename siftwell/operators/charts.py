"""The tables behind charts: series, trendlines, bars, and which finding gets which chart."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import quoted
from siftwell.operators.local import fixed
from siftwell.operators.statistics import group_means, moment_of, pair_table

TRENDLINE_POINTS = 50
# Wording of the output.
NO_CHART_REASON = (
    "No correlation/effect found — best represented as a stated conclusion rather than a chart with no visible pattern."
)
NO_DATA_REASON = "Insufficient non-null overlapping data to render a reliable chart."


@dataclass(frozen=True)
class ChartRouting:
    """Findings with a chart, and the others with the reason why not."""

    charts: DataFrame
    skipped: DataFrame


def line_series(df: DataFrame, date: str, measure: str, every: str | None = None) -> DataFrame:
    """(moment, value) in time order; with `every` (such as "1 day") means and counts per interval instead."""
    points = df.select(moment_of(df, date).alias("moment"), quoted(measure).cast("double").alias("value")).dropna()
    if every is None:
        return points.orderBy("moment", "value")
    grouped = points.groupBy(F.window("moment", every)["start"].alias("moment"))
    return grouped.agg(F.avg("value").alias("value"), F.count("*").alias("n")).orderBy("moment")


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of the rows that have both."""
    return df.select(quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y")).dropna()


def trendline(df: DataFrame, x: str, y: str, points: int = TRENDLINE_POINTS) -> DataFrame:
    """(step, x, y) on the least-squares line at evenly spaced x from lowest to highest; none if x is constant."""
    fit = pair_table(df, [(x, y)]).where(F.col("low_x") < F.col("high_x"))
    step = F.col("step")
    at = F.col("low_x") + (F.col("high_x") - F.col("low_x")) * step / (points - 1)
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return steps.select("step", at.alias("x"), (F.col("intercept") + F.col("slope") * at).alias("y")).orderBy("step")


def bar_series(df: DataFrame, category: str, measure: str) -> DataFrame:
    """(level, mean, n), highest mean first."""
    return group_means(df, category, measure)


SERIES = {"line": line_series, "scatter_with_trendline": scatter_points, "grouped_bar": bar_series}


def chart_data(df: DataFrame, chart_type: str, x: str, y: str) -> DataFrame:
    """The series a finding's chart is drawn from."""
    if chart_type not in SERIES:
        raise ValueError(f"no chart of type {chart_type!r}")
    return SERIES[chart_type](df, x, y)


def route_charts(df: DataFrame, findings: DataFrame) -> ChartRouting:
    """Decide for every finding whether it gets a chart, and count the rows each chart would show.

    One scan counts the rows of all charts; the findings are the few ranked ones.
    """
    wanted = [
        (r["finding_id"], r["recommended_chart"], *r["related_columns"])
        for r in findings.where(F.col("recommended_chart").isin(*SERIES)).collect()
    ]
    present = [w for w in wanted if w[2] in df.columns and w[3] in df.columns]

    def shown(chart: str, x: str, y: str):
        first = moment_of(df, x) if chart == "line" else quoted(x)
        return F.count_if(first.isNotNull() & quoted(y).isNotNull())

    counts = df.agg(*[shown(c, x, y).alias(f"n{i}") for i, (_, c, x, y) in enumerate(present)]).first() if present else ()
    rows = [(w[0], n) for w, n in zip(present, counts)]
    sizes = fixed(df.sparkSession, rows, "finding_id string, n bigint")
    sized = findings.join(F.broadcast(sizes), "finding_id", "left")
    drawable = F.coalesce(F.col("n") > 0, F.lit(False))
    note = F.when(F.col("caveat").isNotNull(), F.concat(F.lit(" (Note: "), F.col("caveat"), F.lit(".)"))).otherwise("")
    charts = sized.where(drawable).select(
        "rank", "finding_id", F.col("recommended_chart").alias("chart_type"), F.concat("summary", note).alias("caption"), "n"
    )
    chart = F.col("recommended_chart")
    reason = (
        F.when(chart == "none", NO_CHART_REASON)
        .when(~chart.isin(*SERIES), F.format_string("No chart builder configured for type '%s'.", chart))
        .otherwise(NO_DATA_REASON)
    )
    skipped = sized.where(~drawable).select("rank", "finding_id", reason.alias("reason"))
    return ChartRouting(charts, skipped)
