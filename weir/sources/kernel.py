"""The kernel ring buffer as a stream.

Registered as format "weir_kmsg".  The device gives one record a read and never
ends, so it is opened without blocking and read until nothing is there.  Offsets
are {boot, seq}: records up to that sequence number of the same boot have been
taken.  Records that the kernel has overwritten meanwhile are passed over.
"""

from __future__ import annotations

import errno
import os
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from weir.sources.tail import Fatal

FORMAT = "weir_kmsg"
DEVICE = "/dev/kmsg"
#: Longest record that the kernel gives.
RECORD_BYTES = 8192
#: Records taken in one micro-batch.
BATCH_RECORDS = 10_000


def available(path: str = DEVICE, platform: str = sys.platform) -> None:
    """Raises where there is no such device."""
    if not platform.startswith("linux"):
        raise Fatal(f"kernel messages need Linux, this is {platform}")
    if not os.path.exists(path):
        raise Fatal(f"{path}: no such device")


def boot_id(path: str = "/proc/sys/kernel/random/boot_id") -> str:
    try:
        with open(path) as file:
            return file.read().strip()
    except OSError:
        return ""


def device_records(path: str, read: Callable[[int, int], bytes] = os.read) -> Iterator[bytes]:
    """Records that are there now, oldest first; lines of key=value pairs, which begin with a space, belong to the one before.

    A device gives one record a read, a file of captured ones as many as fit.
    """
    kept: list[bytes] = []
    for line in _device_lines(path, read):
        if kept and not line.startswith(b" "):
            yield b"\n".join(kept)
            kept = []
        if kept or not line.startswith(b" "):
            kept.append(line)
    if kept:
        yield b"\n".join(kept)


def _device_lines(path: str, read: Callable[[int, int], bytes]) -> Iterator[bytes]:
    handle = os.open(path, os.O_RDONLY | os.O_NONBLOCK)
    rest = b""
    try:
        while True:
            try:
                data = read(handle, RECORD_BYTES)
            except BlockingIOError:
                break
            except OSError as failure:
                if failure.errno == errno.EPIPE:  # overwritten: the next read gives the oldest that is left
                    continue
                raise
            if not data:
                break
            *lines, rest = (rest + data).split(b"\n")
            yield from filter(None, lines)
        if rest:
            yield rest
    finally:
        os.close(handle)


def sequence(record: bytes) -> int | None:
    """The sequence number of a record."""
    parts = record.split(b",", 2)
    return int(parts[1]) if len(parts) > 2 and parts[1].isdigit() else None


class KernelReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", DEVICE)
        self.most = int(options.get("batch_records", BATCH_RECORDS))
        self.from_beginning = options.get("startingoffsets", options.get("startingOffsets", "latest")) == "earliest"
        available(self.path)

    def _after(self, seq: int) -> Iterator[tuple[int, bytes]]:
        for record in device_records(self.path):
            number = sequence(record)
            if number is not None and number > seq:
                yield number, record

    def initialOffset(self) -> dict:
        seq = -1
        if not self.from_beginning:
            for seq, _ in self._after(-1):
                pass
        return {"boot": boot_id(), "seq": seq}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = boot_id()
        seq = start["seq"] if start["boot"] == now else -1
        rows: list[tuple[bytes, bool]] = []
        for number, record in self._after(seq):
            rows.append((record, False))
            seq = number
            if len(rows) >= self.most:
                break
        return iter(rows), {"boot": now, "seq": seq} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """What is still in the ring of that range; records of an earlier boot are gone."""
        if end["boot"] != boot_id():
            return
        low = start["seq"] if start["boot"] == end["boot"] else -1
        for number, record in self._after(low):
            if number > end["seq"]:
                return
            yield record, False


class KernelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "raw binary, truncated boolean"

    def simpleStreamReader(self, schema) -> KernelReader:
        return KernelReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KernelSource)
