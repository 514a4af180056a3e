"""What the operators of this subpackage share: Arrow slicing and staged tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.staging import shared_dir, small_pieces, staged, unstaged, written  # noqa: F401  (the operators take them from here)

#: Bytes of text that one numpy step works on; it bounds a worker's memory.
SLICE_BYTES = 4 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rejected rows whose numbers may be broadcast (16 MB); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df, staged, with a column that numbers its rows, so that equal rows can be told apart; and that column's name."""
    row = fresh(df, "row")
    return staged(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without_rows(df: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """df without the rows whose number is among the rejected (column row), and without that column."""
    rejected = staged(rejected, "rejected")
    if rejected.count() <= BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    return df.join(rejected, row, "left_anti").drop(row)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column holds at most `limit` bytes (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes end to end, and the n + 1 offsets of its rows (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets, along axis 0; zero for empty rows."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
