"""JSONL output: one file in order, partitioned files, and payload blobs."""

from __future__ import annotations

import gzip
import os
import sys
from collections.abc import Iterable
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import jsonl


def open_output(path: str, compress: bool = False) -> IO[bytes]:
    """Standard output for "" and "-", else a new file of mode 0600."""
    raw: IO[bytes] = os.fdopen(os.dup(sys.stdout.fileno()), "wb") if path in ("", "-") else os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "wb")
    if not compress:
        return raw

    class Both(gzip.GzipFile):
        def close(self) -> None:
            super().close()
            raw.close()

    return Both(fileobj=raw, mode="wb")


def write_ordered(records: DataFrame, path: str, compress: bool = False) -> int:
    """Streams ordered records to one local file, a partition at a time; gives their number."""
    written = 0
    with open_output(path, compress) as out:
        for row in records.select(jsonl.to_json().alias("value")).toLocalIterator(prefetchPartitions=True):
            out.write(row[0].encode() + b"\n")
            written += 1
    return written


def write_jsonl(records: DataFrame, path: str, compress: bool = True, partition_by: Iterable[str] = ()) -> None:
    """Writes records as JSONL files in parallel; file names follow the records' order."""
    keys = list(partition_by)
    lines = records.select(*keys, jsonl.to_json().alias("value"))
    writer = lines.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Canonical records of JSONL files, compressed or not, with error_class."""
    return jsonl.from_json(spark.read.option("lineSep", "\n").text(path).where(F.col("value") != ""))


def payload(lines: Iterable[str]) -> bytes:
    """One batch as gzip of JSON lines."""
    return gzip.compress("".join(f"{x}\n" for x in lines).encode(), mtime=0)


def unpack(data: bytes) -> list[str]:
    return gzip.decompress(data).decode().splitlines()
