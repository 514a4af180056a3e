"""Tables written once to the folder that the cluster shares, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one where that is unset and the executors are in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='weir-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes that stay under half a heap region (1 MB for a heap up to 2 GB): what is larger takes whole regions of its own
#: and starts a collection.
PIECE = 384 << 10
#: Layout of staged tables of large values.
WIDE = {"parquet.page.size": PIECE, "parquet.page.size.row.check.min": 10, "parquet.block.size": 2 << 20}
#: Settings inside small_pieces(): rows that are read, and that go to a Python worker, at once; and the buffers that a
#: row group is read into (vectored reads take one for each column).
SMALL = {"spark.sql.parquet.columnarReaderBatchSize": 64, "spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "parquet.read.allocation.size": PIECE, "parquet.hadoop.vectored.io.enabled": "false"}


@contextmanager
def small_pieces(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside hold less in memory at once; the session's settings come back at the end."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    try:
        for k, most in SMALL.items():
            if before[k] is None or most == "false" or not 0 < int(before[k]) < most:
                spark.conf.set(k, most)
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def staged(df: DataFrame, tag: str, level: int = 3, wide: str | None = None) -> DataFrame:
    """df, written once to the shared folder, compressed at the level, and read again.

    This cuts the lineage at a copy that outlives executors, so that several
    consumers read it instead of computing it again.  unstaged() removes it.
    With a column of large values, `wide`, the table has small pages and row
    groups.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weir/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    layout = WIDE | {f"parquet.enable.dictionary#{wide}": "false"} if wide else {}
    df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": level}, **layout).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def staged_text(df: DataFrame, tag: str, separator: str = "\n") -> str:
    """The folder of text files that the one column of df was written to; unstaged() with `since` removes it."""
    path = f"{shared_dir(df.sparkSession)}/weir/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("lineSep", separator).text(path)
    return path


#: Folders written by staged() and not removed yet, oldest first.
_written: list[str] = []


def written() -> int:
    """How many folders staged() has written and nothing has removed."""
    return len(_written)


def unstaged(spark: SparkSession, *frames: DataFrame, since: int | None = None, but: DataFrame | None = None) -> None:
    """Removes staged tables that nobody will read again: the frames, and all written since that many but one."""
    paths = [f.staged_path for f in frames] + (_written[since:] if since is not None else [])
    for path in dict.fromkeys(paths):
        if but is not None and path == but.staged_path:
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _written:
            _written.remove(path)
