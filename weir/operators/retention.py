"""Bounded retention: what a drop-oldest ring or spool holds after all rows have gone through it.

Both have a closed form over newest-first running sums, so nothing is simulated.
Running sums over one global order are taken in two levels: inside ranges of the
order columns, as many as the session's shuffles have partitions, and over the
ranges' totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weir.staging import staged

RING_ENTRIES = 10_000
RING_BYTES = 4 << 20
SPOOL_BYTES = 100 << 20


def running(df: DataFrame, by: str | Sequence[str | Column], value: str, into: str, descending: bool = False) -> DataFrame:
    """Adds the running sum of `value` (whole numbers; null: 0) in the order of `by` (unique), over the whole table.

    One range partitioning, whose ranges Spark samples, sorts the rows; each range
    is summed as a stream and written, so that both levels see the same ranges.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in ([by] if isinstance(by, str | Column) else by)]
    order = [c.desc() for c in order] if descending else order
    return running_in_place(df.repartitionByRange(*order).sortWithinPartitions(*order), value, into)


def running_in_place(df: DataFrame, value: str, into: str) -> DataFrame:
    """Adds the running sum of `value` in the order in which the plan delivers its rows, partition after partition."""
    columns = df.columns

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(pc.fill_null(batch.column(columns.index(value)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) + total
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(np.full(len(sums), part, np.int32))], [*columns, into, "_range"])

    schema = StructType([*df.schema.fields, StructField(into, LongType()), StructField("_range", IntegerType())])
    ranged = staged(df.mapInArrow(summed, schema), "running")
    totals = ranged.groupBy("_range").agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("_total"))
    # One row a range, so a single task orders them, and they are broadcast.
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn(into, F.col(into) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def ring(df: DataFrame, seq: str, max_entries: int = RING_ENTRIES, max_bytes: int = 0, cost: str | None = None) -> DataFrame:
    """Rows that a ring still holds after rows of `seq` 1, 2, ... were pushed; byte cap off at 0.

    The newest row always stays.  With no byte cap only the newest max_entries
    are looked for, without ordering the rest.
    """
    entries = max_entries if max_entries > 0 else RING_ENTRIES
    newest = df.orderBy(F.col(seq).desc()).limit(entries)
    if max_bytes <= 0 or cost is None:
        return newest
    # At most max_entries rows are left, so one task takes their sums.
    w = Window.orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = newest.withColumns({"_size": F.sum(cost).over(w), "_rank": F.row_number().over(Window.orderBy(F.col(seq).desc()))})
    return summed.where((F.col("_size") <= max_bytes) | (F.col("_rank") == 1)).drop("_size", "_rank")


def spool(df: DataFrame, name: str, size: str, max_bytes: int = SPOOL_BYTES) -> DataFrame:
    """Files that a spool still holds: the newest by name whose sizes add up to at most the cap; not even one is sure to stay."""
    limit = max_bytes if max_bytes > 0 else SPOOL_BYTES
    return running(df, name, size, "_size", descending=True).where(F.col("_size") <= limit).drop("_size")


def dropped(df: DataFrame, kept: DataFrame) -> int:
    """Rows that did not stay."""
    return df.count() - kept.count()


def batches(df: DataFrame, seq: str, batch_size: int = 100) -> DataFrame:
    """Adds batch: `batch_size` rows each, in the order of `seq` (unique)."""
    size = batch_size if batch_size > 0 else 100
    numbered = running(df.withColumn("_one", F.lit(1).cast("bigint")), seq, "_one", "_row")
    return numbered.withColumn("batch", F.expr(f"(_row - 1) div {size}")).drop("_one", "_row")
