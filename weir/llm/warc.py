"""WARC archives, and an external merge of their capture indexes.

Captures are written as gzip members of WARC response and revisit records, and
read back.  Every archive gives a run of index rows, sorted locally by URL key,
time and page; a task merges the runs of its archives into longer ones.  The rows
of all runs are then dealt out to key ranges, where what a range got from each run
is still sorted and goes through k-way loser-tree merges of bounded fan-in, pass
by pass, which gives the capture histories in global order.  The ranges come from
Spark's own sample and end with the place of a record, so that neither a URL with
very many captures nor equal captures meet in one task.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import slices, staged

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Index rows aimed at in a range, and runs that one merge takes at most.
RANGE_ROWS = 10_000
FAN_IN = 64
#: Captures of one payload that meet in one task, as a share of all; there are at most as many larger payloads as that leaves room for.
HOT_SHARE = 1 / 500
#: Time of capture of page 0; page n was captured n seconds later.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

_INDEX = "archive string, offset long, length long, page_id long, urlkey string, capture_time string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, then port, path and query, in lower case.

    Scheme, user, leading www., default ports and fragment are left out; what is no URL is kept as it is.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    host = host.removeprefix("www.")
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{shown}){parts.path or '/'}{query}".lower()


def _name(page_id: int | None) -> str:
    return f"<urn:weir:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    shown = (name or "").removeprefix("<urn:weir:page:").rstrip(">")
    return int(shown) if shown.lstrip("-").isdigit() else None


def target_uri(url: str) -> str:
    """The URL as a header can hold it: all but visible ASCII is percent-encoded."""
    return quote(url, safe="".join(map(chr, range(33, 127))))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP headers of its payload without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    moment = EPOCH + timedelta(seconds=max(0, min(page_id or 0, 1 << 37)))
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {moment:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {target_uri(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, WARC headers, block) of each gzip member."""
    view, at = memoryview(archive), 0
    while at < len(view):
        member, parts, to = zlib.decompressobj(31), [], at
        while not member.eof:
            some = view[to : to + 16_384]
            if not some:
                raise ValueError("the archive ends inside a record")
            parts.append(member.decompress(some))
            to += len(some)
        data, length = b"".join(parts), to - at - len(member.unused_data)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = _headers(head)
        yield at, length, headers, rest[: int(headers["content-length"])]
        at += length


def capture(headers: dict[str, str], block: bytes) -> dict:
    """The index row of a record; a stored payload must have the digest that the record names."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, named = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest32(payload) != named:
        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    return {
        "page_id": _page(headers["warc-record-id"]), "urlkey": url_key(headers.get("warc-target-uri")), "capture_time": headers["warc-date"],
        "payload_bytes": len(payload) if kind == "response" else int(_headers(head)["content-length"]), "payload_digest": named, "record_type": kind, "refers_to": _page(headers.get("warc-refers-to")),
    }


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The written archives (archive, data) of pages (page_id, url, html; null html: empty)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    # The smallest page of each payload that occurs again; partial sums leave one row a payload and task to shuffle.
    first = rows.select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = staged(first, "payloads")
    most = max(1, math.ceil(pages.count() * HOT_SHARE))
    hot = F.broadcast(first.where(F.col("n") > most).select("digest", F.ceil(F.col("n") / most).cast("int").alias("parts")))  # fewer than 1 / HOT_SHARE rows
    salted = rows.join(hot, "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), "parts"), F.lit(0)))
    parted = first.join(hot, "digest", "left").select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("salt"))
    typed = salted.join(parted.hint("shuffle_hash"), ["digest", "salt"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = number = 0
        part = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"captures-{part:06d}-{number:06d}.warc.gz"], "data": pa.array([b"".join(members)], pa.binary())})

        for batch in slices(batches, "html"):
            for page_id, url, html, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                revisit = original is not None and page_id != original
                members.append(packer.compress(record(page_id, url, html, original, revisit)) + packer.flush())
                size += len(members[-1])
                if size >= archive_bytes:
                    yield out()
                    members, size, number = [], 0, number + 1
        if members:
            yield out()

    return staged(typed.mapInArrow(run, "archive string, data binary"), "warc")


ROWS = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("urlkey", pa.string()), ("capture_time", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

RUN_ROWS = pa.schema([*ROWS, ("run", pa.string()), ("row", pa.int64())])

#: What captures are ordered by; the last two tell captures of one page and moment apart.
KEY = ("urlkey", "capture_time", "page_id", "archive", "offset")


def _order(row: dict) -> tuple:
    return row["urlkey"], row["capture_time"], row["page_id"] is not None, row["page_id"] or 0, row["archive"], row["offset"]


def _keys(table: pa.Table) -> list[tuple]:
    url, time, page, archive, offset = (table.column(c).to_pylist() for c in KEY)
    return [(u, t, p is not None, p or 0, a, o) for u, t, p, a, o in zip(url, time, page, archive, offset, strict=True)]


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, the winner is on top."""

    def __init__(self, runs: Iterable[Iterable], key):
        self._runs, self._key = [iter(r) for r in runs], key
        k = len(self._runs)
        self._heads: list = [None] * k
        self._keys: list[tuple | None] = [None] * k
        for i in range(k):
            self._advance(i)
        self._losers = [-1] * max(1, k)
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self._losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self._winner = winners[1] if k > 1 else k - 1

    def _advance(self, i: int) -> None:
        self._heads[i] = next(self._runs[i], None)
        self._keys[i] = None if self._heads[i] is None else self._key(self._heads[i])

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; equal keys go by number of run, ended runs last."""
        x, y = self._keys[a], self._keys[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def __iter__(self) -> Iterator:
        while self._winner >= 0 and self._keys[self._winner] is not None:
            yield self._heads[self._winner]
            self._advance(self._winner)
            now, node = self._winner, (self._winner + len(self._runs)) // 2
            while node >= 1:
                if self._beats(self._losers[node], now):
                    now, self._losers[node] = self._losers[node], now
                node //= 2
            self._winner = now


def merged(runs: list[list], key, fan_in: int = FAN_IN) -> list:
    """The items of sorted runs in order, by passes of merges of at most fan_in runs."""
    while len(runs) > 1:
        runs = [list(LoserTree(runs[i : i + fan_in], key)) for i in range(0, len(runs), fan_in)]
    return runs[0] if runs else []


def capture_runs(archives: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Index rows of every archive, read back, with their run and row in it.

    Each archive's rows are sorted by URL key, time and page; up to fan_in archives of a task are merged into a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[list[dict]] = []

        def out() -> pa.RecordBatch:
            rows = merged(read, _order, fan_in)
            table = pa.RecordBatch.from_pylist(rows, ROWS)
            return pa.RecordBatch.from_arrays([*table.columns, pa.array([read[0][0]["archive"]] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())], [*ROWS.names, "run", "row"])

        for batch in slices(batches, "data"):
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
                read.append(sorted(({"archive": name, "offset": at, "length": n} | capture(headers, block) for at, n, headers, block in records(data)), key=_order))
                if len(read) == fan_in:
                    yield out()
                    read = []
        if read:
            yield out()

    return staged(archives.mapInArrow(run, f"{_INDEX}, run string, row long"), "runs")


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Index rows in global order: by range, then by position inside it."""
    ranges = max(1, math.ceil(runs.count() / range_rows))
    dealt = runs.repartitionByRange(ranges, *KEY)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([b for b in batches if b.num_rows] or [], RUN_ROWS)
        if not got.num_rows:
            return
        got = got.sort_by([("run", "ascending"), ("row", "ascending")]).combine_chunks()  # each run's rows together again, as they were
        name = got.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        keys = _keys(got)
        order = merged([s.tolist() for s in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(name)) + 1)], keys.__getitem__, fan_in)
        n, number = len(order), TaskContext.get().partitionId()
        table = got.select(ROWS.names).take(pa.array(order, pa.int64()))
        table = table.append_column("range", pa.array(np.full(n, number, np.int32))).append_column("position", pa.array(np.arange(n)))
        yield from table.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, f"{_INDEX}, range int, position long")


def capture_histories(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC records, reads the archives back and merges their indexes.

    Of equal payloads the smallest page_id is a response and the others revisit
    it; rows of one page_id with equal payloads are alike, all responses if it is
    the smallest; a null page_id revisits any other page of its payload, and is a
    response where there is none.  A null url sorts first; null html is an empty
    payload; other columns are not read; an empty table writes nothing.
    """
    return merge_runs(capture_runs(write_archives(pages)))
