"""Python kernels on columns, whose tasks hold little besides the Arrow batch they are given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: Rows that are unpacked, worked on and given back together.
SLICE = 256
DOUBLES, FLOATS = pa.list_(pa.float64()), pa.list_(pa.float32())


def by_slices(kernel: Callable, returns: str, kind: pa.DataType, *, rows: int = SLICE):
    """A column function: ``kernel`` takes a Series of at most ``rows`` values for each column and gives a list of as many results.

    A batch stays in its compact form, and the results of a slice leave before the next is unpacked, so that what a task
    holds beyond its batch does not grow with the batch.
    """

    @F.arrow_udf(returns)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(columns[0]), rows):
                yield pa.array(kernel(*(c.slice(at, rows).to_pandas() for c in columns)), type=kind)

    return run
