"""Arrow text buffers, and the library's tables under the names used here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.storage import materialize, release, shared_dir, table

__all__ = ["materialize", "release", "shared_dir", "slices", "small_batches", "table", "text_buffers"]

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame, most: int = 2_000) -> DataFrame:
    """``df``, in a session that sends no more than ``most`` rows at once to Python: rows with texts are large,
    and both sides hold a batch whole. A smaller number that the session has is kept."""
    own = int(df.sparkSession.conf.get(_ROWS))
    if own <= 0 or own > most:
        df.sparkSession.conf.set(_ROWS, str(most))
    return df


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (starting at 0) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most_bytes`` of text, so that the arrays made
    from one run stay small whatever the length of the rows (one longer text is a run of its own)."""
    index = batch.schema.get_field_index(column)
    lengths = np.diff(text_buffers(batch.column(index))[1])
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
