"""Parquet sinks for cleaned tables and the tables that document them."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from siftwell.plans.cleaning import CleaningResult
from siftwell.sources.readers import LoadedTable


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write as Parquet. Partition columns should have few values: each becomes a folder."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_cleaning(result: CleaningResult, path: str, mode: str = "errorifexists") -> None:
    """Cleaned table under `data`, outcome of every action under `actions`, scores under `summary`."""
    write_table(result.data, f"{path}/data", mode)
    write_table(result.log, f"{path}/actions", mode)
    write_table(result.summary(), f"{path}/summary", mode)


def write_quarantine(loaded: LoadedTable, path: str, mode: str = "errorifexists") -> None:
    write_table(loaded.quarantined, path, mode)
