"""From a configuration to running streams."""

from __future__ import annotations

import glob
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from weir.config import Config
from weir.security import tls
from weir.sinks.delivery import MQTTPublisher, Publisher, Spool, SpooledPublisher
from weir.sinks.topics import topics
from weir.sources.tail import Fatal
from weir.streaming.buffer import Counters, Gate, Ring
from weir.streaming.ingest import Followed, Status, records, start

log = logging.getLogger(__name__)
#: Seconds before a source that failed is started again, doubled up to the second number.
RESTART_SECONDS, LONGEST_RESTART_SECONDS = 1.0, 60.0


def followed(config: Config) -> list[Followed]:
    """The files, devices and journals that a configuration follows; a pattern follows every file it matches now."""
    out = []
    for name, s in config.sources.items():
        p = config.parsers[s.parser]
        path = "/dev/kmsg" if s.type == "kmsg" else s.path
        one = Followed(name, path, p.type, p.options, s.from_beginning, s.follow_symlinks, config.buffer.max_line_bytes, s.type, tuple(s.units), s.min_priority)
        found = sorted(glob.glob(path)) if s.type == "file" and glob.has_magic(path) else []
        out += [replace(one, name=f"{name}-{k}", path=x) for k, x in enumerate(found)] if found else [one]
    return out


def publisher(config: Config) -> Publisher:
    t = config.transport
    context = tls.client_context(t.client_cert, t.client_key, t.ca_cert)
    return MQTTPublisher(t.mqtt_broker, config.daemon.device_id, context, tls.parse_pin(t.broker_cert_pin) if t.broker_cert_pin else None, topics(config.daemon.tenant, config.daemon.device_id).status)


@dataclass
class Running:
    """A source, how it is started, and how it fares."""

    source: Followed
    begin: Callable[[], StreamingQuery]
    counters: Counters = field(default_factory=Counters)
    query: StreamingQuery | None = None
    failures: int = 0
    due: float = 0.0
    fatal: str = ""

    def step(self, now: float) -> None:
        """Starts the source where it is due, and notes a failure; one that a restart does not mend ends it."""
        if self.fatal or self.query is not None and self.query.isActive:
            return
        failure: object = None
        if self.query is not None:
            failure, self.query = self.query.exception(), None
            if failure is None:
                self.fatal = "ended"
                return
        elif now >= self.due:
            try:
                self.query = self.begin()
            except Exception as problem:  # one source's failure is its own
                failure = problem
        if failure is not None:
            log.warning("source %s: %s", self.source.name, next((x for x in reversed(str(failure).splitlines()) if x.strip()), type(failure).__name__))
            self.failures += 1
            self.due = now + min(LONGEST_RESTART_SECONDS, RESTART_SECONDS * 2 ** (self.failures - 1))
            if isinstance(failure, Fatal) or f"{Fatal.__module__}.{Fatal.__name__}" in str(failure):  # Spark hands on the text of what a source raised
                self.fatal = str(failure)


class Service:
    """One query a source, each with its checkpoint under the state folder, over one spool and its replay."""

    def __init__(self, spark: SparkSession, config: Config, upstream: Publisher, once: bool = False):
        named = topics(config.daemon.tenant, config.daemon.device_id)
        self.spark, self.config = spark, config
        self.out = SpooledPublisher(upstream, Spool(f"{config.daemon.state_dir}/spool", config.spool.max_size_bytes), named.logs, config.transport.qos_logs)
        self.status = Status(upstream, named.status)
        interval = f"{config.buffer.batch_interval.total_seconds()} seconds"
        self.sources: list[Running] = []
        for f in followed(config):
            counters = Counters()
            options = {"gate": Gate(config.rate_limit.per_source_lines_per_sec, 0), "ring": Ring(config.buffer.max_entries, config.buffer.max_bytes), "counters": counters}
            begin = lambda f=f, options=options: start(records(spark, f), self.out, f"{config.daemon.state_dir}/offsets/{f.name}", config.buffer.batch_size, interval, once, f.name, **options)
            self.sources.append(Running(f, begin, counters))

    def begin(self) -> None:
        self.spark.streams.addListener(self.status)
        self.out.start()
        self.step()

    def step(self) -> bool:
        """Starts what is due; whether any source is still to run."""
        for r in self.sources:
            r.step(time.monotonic())
        return any(not r.fatal for r in self.sources)

    def end(self) -> None:
        for r in self.sources:
            if r.query is not None and r.query.isActive:
                r.query.stop()
        self.out.close()
        self.spark.streams.removeListener(self.status)

    def run(self, every: float = 0.5) -> None:
        """Runs until no source is left."""
        self.begin()
        try:
            while self.step():
                time.sleep(every)
        finally:
            self.end()


def run(spark: SparkSession, config: Config) -> None:
    Service(spark, config, publisher(config)).run()
