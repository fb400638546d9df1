"""Arrow batches in pieces of bounded size, for operators that run in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most ``size`` bytes of text, or a single row, so that what is made of few rows is held at once."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[at] - lengths[at] + size, "right"))
        yield batch.slice(at, max(stop, at + 1) - at)
        at = max(stop, at + 1)
