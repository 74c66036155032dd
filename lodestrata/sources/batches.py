"""Arrow batches of a bounded size, for passes over long texts and bodies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame

#: Texts are worked on in slices of about so many bytes, which bounds the memory of a task.
SLICE_BYTES = 4_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(frame: DataFrame) -> DataFrame:
    """frame, after the session's Arrow batches are limited to SLICE_BYTES; the number of rows, and a lower limit of bytes that the user has set, stay as they are.

    The plan runs later, so the setting cannot be put back here; it is the same for every operator, so none changes how another one runs.
    """
    conf = frame.sparkSession.conf
    held = str(conf.get(BATCH_BYTES)).removesuffix("b")
    if not held.lstrip("-").isdigit() or not 0 < int(held) <= SLICE_BYTES:
        conf.set(BATCH_BYTES, SLICE_BYTES)
    return frame


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about `most` bytes; one longer text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pa.compute.binary_length(array).fill_null(0)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
