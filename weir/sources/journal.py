"""The running system's journal as a stream.

Registered as format "weir_journal".  Every micro-batch runs the export command
after the cursor that the last one ended at, and takes whole records up to a
number of bytes; the offset is that cursor, so a batch that is tried again reads
the same records.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from weir.sources.batch import journal_arguments
from weir.sources.tail import MAX_LINE_BYTES, Fatal

FORMAT = "weir_journal"
BATCH_BYTES = 8 << 20


def export_records(stream, most: int = BATCH_BYTES) -> Iterator[bytes]:
    """Records between blank lines of an export, as text lines, until `most` bytes have been read.

    A field whose line has no equals sign is binary: eight bytes of length, little-endian, and the value; it is left out.
    """
    lines: list[bytes] = []
    size = 0
    while line := stream.readline():
        size += len(line)
        line = line.rstrip(b"\r\n")
        if line:
            if b"=" in line:
                lines.append(line)
            else:
                length = int.from_bytes(stream.read(8), "little")
                while length > 0 and (part := stream.read(min(length, 1 << 16))):
                    length -= len(part)
                stream.readline()
        elif lines:
            yield b"\n".join(lines)
            lines = []
            if size >= most:
                return
    if lines:
        yield b"\n".join(lines)


def cursor_of(record: bytes) -> str:
    for line in record.split(b"\n"):
        if line.startswith(b"__CURSOR="):
            return line[9:].decode(errors="replace")
    return ""


class JournalReader(SimpleDataSourceStreamReader):
    """Options: units (a JSON list), priority, directory, command (a JSON list, in place of journalctl)."""

    def __init__(self, options: dict[str, str]):
        self.limit = int(options.get("max_line_bytes", MAX_LINE_BYTES))
        self.batch = int(options.get("batch_bytes", BATCH_BYTES))
        self.from_beginning = options.get("startingoffsets", options.get("startingOffsets", "latest")) == "earliest"
        command = journal_arguments(tuple(json.loads(options.get("units", "[]"))), int(options.get("priority", 0)), options.get("directory", ""))
        self.command = json.loads(options["command"]) + command[1:] if "command" in options else command

    def _records(self, after: str, *more: str) -> Iterator[bytes]:
        command = self.command + (["--after-cursor", after] if after else []) + list(more)
        try:
            running = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        except FileNotFoundError:
            raise Fatal(f"{command[0]}: not found") from None
        try:
            yield from export_records(running.stdout, self.batch)
        finally:
            running.stdout.close()
            running.terminate()
            running.wait()

    def initialOffset(self) -> dict:
        cursor = ""
        if not self.from_beginning:
            for record in self._records("", "-n", "1"):
                cursor = cursor_of(record)
        return {"cursor": cursor}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, cursor = [], start["cursor"]
        for record in self._records(cursor):
            rows.append((record[: self.limit], len(record) >= self.limit))
            cursor = cursor_of(record) or cursor
        return iter(rows), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if start["cursor"] == end["cursor"]:
            return
        for record in self._records(start["cursor"]):
            yield record[: self.limit], len(record) >= self.limit
            if cursor_of(record) == end["cursor"]:
                return


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "raw binary, truncated boolean"

    def simpleStreamReader(self, schema) -> JournalReader:
        return JournalReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JournalSource)
