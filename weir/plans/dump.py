"""The export: several captured sources, filtered, merged in time order, capped, written as JSONL."""

from __future__ import annotations

import logging
import tempfile
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from weir.operators.filters import TimeRange
from weir.operators.merge import merge
from weir.sources import kernel
from weir.sources.batch import Source, capture, dmesg_arguments, journal_arguments

log = logging.getLogger(__name__)


def sources(syslog_bsd: Sequence[str] = (), syslog_rfc5424: Sequence[str] = (), kmsg: str | None = None, dmesg: str | None = None, journal: str | None = None, journal_units: Sequence[str] = (), year: int | None = None) -> list[Source]:
    """Sources in their fixed order and with their labels; BSD stamps are UTC of the current year."""
    bsd = {"default_year": year or datetime.now(UTC).year, "timezone": "UTC"}
    out = [Source(p, "syslog_bsd", f"syslog_bsd:{p}", bsd) for p in syslog_bsd]
    out += [Source(p, "syslog_rfc5424", f"syslog_rfc5424:{p}") for p in syslog_rfc5424]
    out += [Source(p, name, name) for name, p in (("kmsg", kmsg), ("dmesg", dmesg)) if p]
    return out + ([Source(journal, "journald", "journal", units=tuple(journal_units))] if journal else [])


def captured(dmesg: bool = False, journal: bool = False, units: Sequence[str] = (), folder: str | None = None, within: TimeRange = TimeRange(), kmsg: str = "") -> dict[str, str]:
    """Paths of the running system's dmesg, journal and kernel ring, captured on the driver; one that fails is left out.

    The journal is asked for the time range alone; the range itself is applied again later.
    """
    folder = folder or tempfile.mkdtemp(prefix="weir-capture-")
    out = {}
    since, until = (t.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S UTC") if t else "" for t in (within.since, within.until and within.until + timedelta(seconds=1)))
    for wanted, name, command in ((dmesg, "dmesg", dmesg_arguments()), (journal, "journal", journal_arguments(tuple(units), since=since, until=until))):
        if wanted:
            try:
                out[name] = capture(command, f"{folder}/{name}")
            except OSError as failure:
                log.warning("%s: %s", name, failure)
    if kmsg:
        try:
            with open(f"{folder}/kmsg", "wb") as file:
                file.writelines(r + b"\n" for r in kernel.device_records(kmsg))
            out["kmsg"] = f"{folder}/kmsg"
        except OSError as failure:
            log.warning("kmsg: %s", failure)
    return out


def dump(spark: SparkSession, inputs: Sequence[Source], within: TimeRange = TimeRange(), max_lines: int = 0) -> DataFrame:
    """Merged records; a source that cannot be opened is reported and left out, one that fails later ends there."""
    read = []
    for source in inputs:
        try:
            read.append(source.read(spark, within, isolated=True))
        except PySparkException as failure:
            log.warning("%s: %s", source.label, str(failure).splitlines()[0])
    if not read:
        raise ValueError("no source can be read")
    return merge(read, max_lines)
