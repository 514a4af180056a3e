"""A streaming source that follows a growing local file.

Registered as format "weir_tail".  Offsets are {inode, position, skipping}: only
finished records are taken, so one written in parts is one record (a last one
without end is taken once the file has been rotated away).  Records end with a
line feed, or with a blank line for journal exports (framing "blank").  A file
that has been replaced is read from its start, one that has shrunk too; what was
not yet read of a rotated file is looked for beside it by inode.  Records are cut
to max_line_bytes and flagged; of one that does not end within a batch the first
bytes are given and the rest is passed over, whatever its size.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FORMAT = "weir_tail"
MAX_LINE_BYTES = 64 * 1024
#: Bytes read in one micro-batch.
BATCH_BYTES = 16 << 20


class Fatal(RuntimeError):
    """A failure that a restart does not mend."""


def start_offset(path: str, kept: dict | None, from_beginning: bool, follow_symlinks: bool = False) -> dict:
    """Where to begin: at a kept offset of the same, not shrunk file; at its start if it is another; else at its end."""
    try:
        found = os.lstat(path)
    except FileNotFoundError:
        return {"inode": 0, "position": 0}
    if stat.S_ISLNK(found.st_mode):
        if not follow_symlinks:
            raise Fatal(f"refusing to open symlink {path}")
        found = os.stat(path)
    if from_beginning:
        return {"inode": found.st_ino, "position": 0}
    if kept and kept.get("inode"):
        same = kept["inode"] == found.st_ino and kept["position"] <= found.st_size
        return {"inode": found.st_ino, "position": kept["position"] if same else 0}
    return {"inode": found.st_ino, "position": found.st_size}


def by_inode(path: str, inode: int) -> str | None:
    """The file of that inode: at the path, or renamed beside it."""
    folder = os.path.dirname(path) or "."
    for name in [os.path.basename(path), *sorted(os.listdir(folder))] if os.path.isdir(folder) else []:
        candidate = os.path.join(folder, name)
        try:
            if os.stat(candidate).st_ino == inode:
                return candidate
        except FileNotFoundError:
            continue
    return None


def cut_lines(data: bytes, limit: int, separator: bytes = b"\n") -> Iterator[tuple[bytes, bool]]:
    """(record without its end, truncated) of data that ends with a record; blank ones between blank lines are none."""
    for record in data.removesuffix(separator).split(separator):
        if separator != b"\n":
            record = record.strip(b"\r\n")
            if not record:
                continue
        yield record[:limit], len(record) >= limit


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.limit = int(options.get("max_line_bytes", MAX_LINE_BYTES))
        self.batch = max(int(options.get("batch_bytes", BATCH_BYTES)), self.limit + 2)
        self.from_beginning = options.get("startingoffsets", options.get("startingOffsets", "latest")) == "earliest"
        self.follow = options.get("follow_symlinks", "false").lower() == "true"
        self.separator = b"\n\n" if options.get("framing", "line") == "blank" else b"\n"

    def initialOffset(self) -> dict:
        return start_offset(self.path, None, self.from_beginning, self.follow)

    def _step(self, path: str, position: int, skipping: bool, most: int, whole: bool = False) -> tuple[list[tuple[bytes, bool]], int, bool]:
        """(records, position, skipping) after at most `most` bytes; whole: an unfinished last record counts."""
        with open(path, "rb") as file:
            file.seek(position)
            data = file.read(most)
        if skipping:  # the rest of a record whose first bytes have been given
            end = data.find(self.separator)
            if end < 0:
                kept = 0 if whole else len(self.separator) - 1  # its end may be cut in two
                return [], position + max(0, len(data) - kept), not (whole and len(data) < most)
            position, data = position + end + len(self.separator), data[end + len(self.separator) :]
            return [], position, False
        end = data.rfind(self.separator) + len(self.separator)
        if end < len(self.separator):
            if len(data) >= most:
                return [(data[: self.limit], True)], position + len(data) - len(self.separator) + 1, True
            end = len(data) if whole else 0
        return list(cut_lines(data[:end], self.limit, self.separator)) if end else [], position + end, False

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        inode, position, skipping = start["inode"], start["position"], bool(start.get("skipping"))
        now = start_offset(self.path, start, False, self.follow)

        def taken(path: str, of: int, at: int, skip: bool, whole: bool = False) -> tuple[Iterator[tuple], dict]:
            rows, to, skip = self._step(path, at, skip, self.batch, whole)
            if not rows and to > at and not skip:  # the end of a skipped record; what follows it is for now too
                rows, to, skip = self._step(path, to, False, self.batch, whole)
            return iter(rows), {"inode": of, "position": to} | ({"skipping": True} if skip else {})

        if inode and inode != now["inode"] and (old := by_inode(self.path, inode)):  # rotated: first what is left of the old file
            rows, end = taken(old, inode, position, skipping)
            if end["position"] == position:
                rows, end = taken(old, inode, position, skipping, whole=True)
            if end["position"] > position:
                return rows, end
        if not now["inode"]:
            return iter([]), start
        same = now["inode"] == inode and now["position"] == position
        if not os.path.exists(self.path):
            return iter([]), start
        return taken(self.path, now["inode"], now["position"] if now["inode"] == inode else 0, skipping and same)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        same = start["inode"] == end["inode"] and start["position"] <= end["position"]
        position, skipping = (start["position"], bool(start.get("skipping"))) if same else (0, False)
        path = by_inode(self.path, end["inode"])
        if path is None:
            raise Fatal(f"the file of inode {end['inode']} is gone from beside {self.path}")
        while position < end["position"]:
            rows, to, skipping = self._step(path, position, skipping, min(self.batch, end["position"] - position), whole=end["position"] - position < self.batch and not end.get("skipping"))
            if to == position:
                return
            yield from rows
            position = to


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "raw binary, truncated boolean"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
