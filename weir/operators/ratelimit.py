"""Token buckets, one a source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES_PER_SEC = 10_000


def settings(lines_per_sec: float = 0, burst: float = 0) -> tuple[float, float]:
    """(rate, burst) with their defaults: 10 000 a second, and a second's worth."""
    rate = float(lines_per_sec) if lines_per_sec > 0 else float(LINES_PER_SEC)
    return rate, float(burst) if burst > 0 else rate


def decide(tokens: float, last: int, times: np.ndarray, rate: float, burst: float) -> tuple[np.ndarray, float, int]:
    """Which arrivals (microseconds, in order) are let through; the bucket's tokens and time after them.

    Time only moves forward: an earlier stamp neither refills nor rewinds.
    """
    out = np.zeros(len(times), bool)
    for k, now in enumerate(times.tolist()):
        if now > last:
            tokens = min(burst, tokens + (now - last) / 1e6 * rate)
            last = now
        if tokens >= 1:
            tokens -= 1
            out[k] = True
    return out, tokens, last


def limit(df: DataFrame, source: str, ts: str, seq: str, lines_per_sec: float = 0, burst: float = 0) -> DataFrame:
    """(source, seq, allowed) of every row, arrivals in the order of `seq` in each source.

    Rows of one source arrive as a sorted stream in one task, a batch at a time,
    so a source of any size is never held; sources are independent.
    """
    rate, full = settings(lines_per_sec, burst)
    rows = df.select(F.col(source).cast("string").alias("source"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(seq).cast("long").alias("seq"))
    dealt = rows.repartition("source").sortWithinPartitions("source", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tokens, last = None, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, at = batch.column("source").to_pylist(), batch.column("at").to_numpy(zero_copy_only=False)
            allowed, start = np.zeros(len(names), bool), 0
            while start < len(names):
                end = start
                while end < len(names) and names[end] == names[start]:
                    end += 1
                if current != (names[start],):
                    current, tokens, last = (names[start],), full, int(at[start])
                allowed[start:end], tokens, last = decide(tokens, last, at[start:end], rate, full)
                start = end
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("seq"), pa.array(allowed)], ["source", "seq", "allowed"])

    return dealt.mapInArrow(run, "source string, seq long, allowed boolean")
