"""Arrow batches inside tasks, cut so that a task never holds more than a few megabytes of text at once."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

TEXT_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes in `column`; a longer value comes alone."""
    values = batch.column(column)
    start, held = 0, 0
    for i, size in enumerate(pa.compute.binary_length(values).to_pylist()):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """`batch` with these columns at its end; columns of the same names go."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns.values()], [*kept, *columns])
