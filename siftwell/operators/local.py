"""Small result tables fixed on the driver, and independent jobs at the same time."""

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fixed(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """A local relation of the given rows, for tables with a few rows per column or test.

    Catalyst evaluates projections and filters over it while planning, so reading it costs no job.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds])
    columns = list(zip(*rows)) or [()] * len(nullable)
    arrow = to_arrow_schema(nullable)
    arrays = [pa.array(list(c), type=arrow.field(i).type) for i, c in enumerate(columns)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), nullable)


def collected(df: DataFrame) -> DataFrame:
    """`df` computed once; only for tables whose size does not grow with the data."""
    return fixed(df.sparkSession, df.collect(), df.schema)


def together(spark: SparkSession, *tasks: Callable) -> list:
    """Results of independent tasks whose jobs share the cluster instead of waiting for each other."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [task.result() for task in running]
