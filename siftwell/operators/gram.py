"""Sums of all pairs of many columns from products of matrices."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4_096
SUMS = ("n", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")


def pair_sums(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """(i, j, sums of x and y) for all i < j, over the rows in which both the i-th and the j-th value are there.

    Each task takes blocks of rows as matrices, without the columns of other use, and adds the products of values,
    squares and presences. A task gives one row per pair, whatever the number of its rows, and holds eight numbers per
    pair. Pairs without a common row have none.
    """
    c = len(values)
    names = [f"v{i}" for i in range(c)]
    block_rows, sum_names = BLOCK_ROWS, SUMS

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                yield np.column_stack([column.to_numpy(zero_copy_only=False) for column in part.columns])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((c, c)) for _ in range(4))
        for block in blocks(batches):
            there = ~np.isnan(block)
            mask, filled = there.astype(float), np.where(there, block, 0.0)
            n += mask.T @ mask
            # Row i, column j: over the i-th value where the j-th is there.
            sx += filled.T @ mask
            sxx += (filled * filled).T @ mask
            sxy += filled.T @ filled
        for i in range(c - 1):
            j = np.arange(i + 1, c)
            j = j[n[i, j] > 0]
            if not len(j):
                continue
            sums = (n[i, j].astype(np.int64), sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j])
            columns = [np.full(len(j), i, np.int32), j.astype(np.int32), *sums]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["i", "j", *sum_names])

    matrix = df.select(*[v.cast("double").alias(name) for v, name in zip(values, names)])
    kinds = ", ".join(f"{s} {'bigint' if s == 'n' else 'double'}" for s in SUMS)
    parts = matrix.mapInArrow(summed, f"i int, j int, {kinds}")
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
