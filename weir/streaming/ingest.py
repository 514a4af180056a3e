"""Service mode: follow sources, parse, batch, publish, fall back on a spool."""

from __future__ import annotations

import json
import logging
import os
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weir.functions import jsonl, text
from weir.operators import parsers
from weir.operators.filters import journal_priority, journal_units
from weir.operators.retention import RING_ENTRIES
from weir.sinks.delivery import Publisher, SpooledPublisher
from weir.sinks.files import payload
from weir.sources import journal, kernel, tail
from weir.streaming.buffer import Counters, Gate, Ring

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Followed:
    """A file, device or journal to follow and how to parse it; kind: file, kmsg or journal."""

    name: str
    path: str
    parser: str
    options: dict[str, Any] | None = None
    from_beginning: bool = False
    follow_symlinks: bool = False
    max_line_bytes: int = tail.MAX_LINE_BYTES
    kind: str = "file"
    units: tuple[str, ...] = ()
    min_priority: int = 0
    command: tuple[str, ...] = ()


def raw(spark: SparkSession, source: Followed) -> DataFrame:
    """The stream of a source's records as bytes, with a flag for those cut."""
    given = {"max_line_bytes": source.max_line_bytes, "startingOffsets": "earliest" if source.from_beginning else "latest"}
    if source.kind == "journal" and not os.path.isfile(source.path):  # a journal folder, or without a path the system's; a file holds exported records
        module = journal
        given |= {"units": json.dumps(source.units), "priority": source.min_priority, "directory": source.path} | ({"command": json.dumps(source.command)} if source.command else {})
    elif source.kind == "kmsg":
        module, given = kernel, given | {"path": source.path}
    else:
        module = tail
        given |= {"path": source.path, "follow_symlinks": str(source.follow_symlinks).lower(), "framing": "blank" if source.parser == "journald" else "line"}
    module.register(spark)
    return spark.readStream.format(module.FORMAT).options(**given).load()


def records(spark: SparkSession, source: Followed) -> DataFrame:
    """The stream of a source's canonical records, with error_class; cut lines are flagged in fields."""
    parsed = parsers.build(source.parser, source.options).parse(raw(spark, source).select(F.col("raw").cast("string").alias("value"), "truncated"))
    flagged = F.when(F.col("truncated"), F.map_concat(F.map_filter("fields", lambda k, _: k != "truncated"), F.create_map(F.lit("truncated"), F.lit("true")))).otherwise(F.col("fields"))
    out = parsed.withColumns({"src": F.lit(source.name), "msg": text.repair_utf8(F.col("msg")), "fields": flagged})
    wanted = journal_units(source.units) & journal_priority(source.min_priority)
    return out.where(F.col("error_class").isNotNull() | wanted) if source.parser == "journald" else out


def identity(checkpoint: str) -> str:
    """A name for the progress kept in a checkpoint folder: another one once that folder has been removed."""
    path = Path(checkpoint) / "weir-id"
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(uuid.uuid4().hex[:12])
    return path.read_text()


def deliver(publisher: SpooledPublisher, batch_size: int = 100, qos: int = 1, key: str = "source", gate: Gate | None = None, ring: Ring | None = None, counters: Counters | None = None, clock: Callable[[], float] = time.monotonic, patience: float = 60.0):
    """A foreachBatch function: payloads of at most batch_size records, in order of arrival.

    Lines pass the source's gate and wait in its ring for a thread that publishes
    them, so a slow publisher does not hold the reading up before the ring is
    full; then the reader waits up to `patience` seconds before the oldest are
    dropped and counted.  Payloads are keyed by source, batch and part, so that a
    batch that is tried again replaces what it has spooled before, and nothing else.
    """
    counters = counters if counters is not None else Counters()
    ring_size = (ring.max_entries, ring.max_bytes) if ring is not None else (max(RING_ENTRIES, batch_size), 0)

    def run(batch: DataFrame, number: int) -> None:
        publisher.replay()
        waiting, failures = Ring(*ring_size), []

        def publish() -> None:
            part = 0
            try:
                while lines := waiting.pop(batch_size, 3600):
                    publisher.publish(publisher.topic, payload(lines), qos, False, key=f"{key}-{number:012}-{part:08}")
                    counters.published += len(lines)
                    part += 1
            except Exception as failure:  # a failing spool: the batch fails and is tried again
                failures.append(failure)
                waiting.close()

        thread = threading.Thread(target=publish, daemon=True)
        thread.start()
        rows = batch.select(F.when(F.col("error_class").isNull(), jsonl.to_json()).alias("value"), F.when(F.col("error_class").isNull(), text.entry_cost()).alias("cost"))
        for value, cost in rows.toLocalIterator():  # one device's micro-batch, bounded by the source's read limit
            counters.read += 1
            if value is None:
                counters.failed += 1
            elif gate is not None and not gate.admit(clock()):
                counters.limited += 1
            else:
                waiting.room(patience)
                if failures:
                    break
                waiting.push(value, cost)
        waiting.close()
        thread.join()
        counters.overflowed += waiting.drops
        if failures:
            raise failures[0]

    return run


def start(stream: DataFrame, publisher: SpooledPublisher, checkpoint: str, batch_size: int = 100, interval: str = "5 seconds", once: bool = False, name: str = "source", **options: Any) -> StreamingQuery:
    """Runs a stream of records into a publisher; progress is kept in the checkpoint."""
    run = deliver(publisher, batch_size, key=f"{name}-{identity(checkpoint)}", **options)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


class Status(StreamingQueryListener):
    """Publishes online and offline as retained messages, when the first query starts and the last one ends."""

    def __init__(self, publisher: Publisher, topic: str):
        self.publisher, self.topic = publisher, topic
        self._running: set[str] = set()

    def _send(self, online: bool) -> None:
        try:
            self.publisher.publish(self.topic, json.dumps({"online": online}).encode(), 1, True)
        except Exception as failure:  # nobody to tell
            log.warning("status was not published: %s", failure)

    def onQueryStarted(self, event) -> None:
        if not self._running:
            self._send(True)
        self._running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._running.discard(str(event.runId))
        if not self._running:
            self._send(False)
