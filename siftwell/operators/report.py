"""Report tables: schema overview, methodology, findings and headline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.charts import ChartRouting

TECHNICAL = ("rank", "summary", "statistical_support", "confidence", "caveat", "chart_type", "n", "no_chart_reason")
EXECUTIVE = ("rank", "summary", "caveat", "chart_type")


def schema_overview(profile: DataFrame) -> DataFrame:
    """(position, column, type, null_share, unique) from a column profile."""
    share = F.format_string("%.1f%%", F.col("null_pct") * 100)
    return profile.select(
        "position",
        "column",
        F.col("inferred_type").alias("type"),
        share.alias("null_share"),
        F.col("unique_count").alias("unique"),
    )


def methodology(log: DataFrame) -> DataFrame:
    """(sequence, section, action, column, reason, count, method): what was applied, and what was reviewed but not."""
    section = F.when(F.col("status") == "approved", "applied").otherwise("reviewed but not applied")
    return log.select("sequence", section.alias("section"), "action", "column", "reason", "count", "method").orderBy(
        F.col("section"), "sequence"
    )


def findings_table(findings: DataFrame, routing: ChartRouting, audience: str = "technical") -> DataFrame:
    """Findings in rank order with their chart or the reason for none; fewer columns for executives."""
    charts = routing.charts.select("finding_id", "chart_type", "n")
    skipped = routing.skipped.select("finding_id", F.col("reason").alias("no_chart_reason"))
    joined = findings.join(charts, "finding_id", "left").join(skipped, "finding_id", "left")
    return joined.select(*(EXECUTIVE if audience == "executive" else TECHNICAL)).orderBy("rank")


def headline(findings: DataFrame, cleaning_summary: DataFrame) -> DataFrame:
    """(headline, finding_count, quality_score_before, quality_score_after)."""
    top = findings.agg(
        F.min(F.struct("rank", "summary"))["summary"].alias("top"), F.count("*").alias("finding_count")
    ).select(
        F.coalesce("top", F.lit("No statistically significant findings were surfaced from this dataset.")).alias("headline"),
        "finding_count",
    )
    scores = cleaning_summary.select("quality_score_before", "quality_score_after")
    columns = ("headline", "finding_count", "quality_score_before", "quality_score_after")
    return top.unionByName(scores, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in columns])
