"""Spark-native data quality: load, profile, clean with an audit log, and find what the data supports."""

from siftwell.operators.charts import chart_data, route_charts, trendline
from siftwell.operators.findings import analyze, findings_of, test_statistics
from siftwell.operators.profile import column_profile
from siftwell.operators.quality import quality_score
from siftwell.operators.report import findings_table, headline, methodology, schema_overview
from siftwell.operators.statistics import describe
from siftwell.plans.cleaning import CleaningPlan, CleaningResult, apply_cleaning, propose_cleaning
from siftwell.plans.ingestion import IngestionReport, ingestion_report
from siftwell.sources.readers import LoadedTable, load_table
from siftwell.sources.writers import write_cleaning, write_quarantine, write_table

__all__ = [
    "CleaningPlan",
    "CleaningResult",
    "IngestionReport",
    "LoadedTable",
    "analyze",
    "apply_cleaning",
    "chart_data",
    "column_profile",
    "describe",
    "findings_of",
    "findings_table",
    "headline",
    "ingestion_report",
    "load_table",
    "methodology",
    "propose_cleaning",
    "quality_score",
    "route_charts",
    "schema_overview",
    "test_statistics",
    "trendline",
    "write_cleaning",
    "write_quarantine",
    "write_table",
]
