"""Ingestion report: what was loaded, what its columns hold, and what looks wrong about the source."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.profile import EMPTY_SHARE, column_profile
from siftwell.sources.readers import LoadedTable


@dataclass(frozen=True)
class IngestionReport:
    """Summary row, column profile, structural issues and a few rows of a loaded table."""

    summary: DataFrame
    profile: DataFrame
    issues: DataFrame
    sample_rows: DataFrame


def ingestion_report(loaded: LoadedTable, exact: bool = True) -> IngestionReport:
    profile = column_profile(loaded.data, exact=exact)
    empty = profile.where(F.col("null_pct") >= EMPTY_SHARE)
    names = F.array_sort(F.collect_list(F.struct("position", "column")))
    listed = F.array_join(F.transform(names, lambda n: n["column"]), "', '")
    found = empty.agg(F.count("*").alias("n"), listed.alias("columns")).where(F.col("n") > 0)
    blank = found.select(F.concat(F.lit("Column(s) entirely empty: ['"), F.col("columns"), F.lit("']")).alias("issue"))
    return IngestionReport(loaded.summary(), profile, loaded.issues.unionByName(blank), loaded.sample_rows())
