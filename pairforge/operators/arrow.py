"""Arrow batches inside tasks, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that are worked on together, or one row.
SLICE = 1 << 20


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows of at most ``most`` bytes, or one row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        end = int(np.searchsorted(ends, ends[at] - sizes[at] + most, side="right"))
        end = max(end, at + 1)
        yield at, end - at
        at = end


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[list]]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` whose function is made once in each task.

    ``make()`` returns a function from a batch to lists of equally long columns.
    """
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for columns in each(batch):
                arrays = [
                    c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                    for c, f in zip(columns, kinds)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return df.mapInArrow(run, schema)
