"""Bit tables of a fixed size that tell tasks which keys may be wanted; a wrong hit is possible, a miss is not."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE_BITS = 24

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _places(columns: tuple[np.ndarray, ...]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ (h >> np.uint64(29)) ^ c.view(np.uint64)) * _MIX
    return h >> np.uint64(64 - SIZE_BITS)


class Bits:
    def __init__(self):
        self.table = np.zeros(1 << SIZE_BITS - 3, np.uint8)

    def hit(self, *columns: np.ndarray) -> np.ndarray:
        """Whether each row of the columns, 64-bit keys, may have been marked."""
        at = _places(columns)
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bits(keys: DataFrame, *columns: str) -> Bits:
    """A table with the rows of `keys` marked; it takes as many bytes to the driver whatever their number."""
    import pyarrow as pa

    def run(batches):
        seen = np.zeros(1 << SIZE_BITS, bool)
        for batch in batches:
            if batch.num_rows:
                seen[_places(tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns))] = True
        words = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    found = keys.select(*columns).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = Bits()
    out.table.view(np.int64)[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return out
