"""Predicates over canonical records."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import times


@dataclass(frozen=True)
class TimeRange:
    """A range closed on both ends; None is unbounded."""

    since: datetime | None = None
    until: datetime | None = None

    def predicate(self, ts: Column | None = None) -> Column:
        """An unknown time fails any since and passes any until."""
        ts = F.col("ts") if ts is None else ts
        out = F.lit(True)
        if self.since is not None:
            out = out & F.coalesce(ts >= F.timestamp_micros(F.lit(times.unix_micros(self.since))), F.lit(False))
        if self.until is not None:
            out = out & F.coalesce(ts <= F.timestamp_micros(F.lit(times.unix_micros(self.until))), F.lit(True))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df if self.since is None and self.until is None else df.where(self.predicate())


def time_range(since: str = "", until: str = "", now: datetime | None = None) -> TimeRange:
    """A range from texts: since is a duration before now or an RFC 3339 time, until an RFC 3339 time."""
    low = high = None
    if since:
        try:
            low = (now or datetime.now(UTC)) - times.duration(since)
        except ValueError:
            try:
                low = times.parse_rfc3339(since)
            except ValueError:
                raise ValueError(f"--since {since!r} is neither a duration nor an RFC 3339 time") from None
    if until:
        try:
            high = times.parse_rfc3339(until)
        except ValueError:
            raise ValueError(f"--until {until!r} is no RFC 3339 time") from None
    return TimeRange(low, high)


def journal_units(units: Iterable[str]) -> Column:
    """Entries of any of the units; all entries for no units."""
    units = list(units)
    return F.coalesce(F.try_element_at("fields", F.lit("_SYSTEMD_UNIT")).isin(units), F.lit(False)) if units else F.lit(True)


def journal_priority(most: int) -> Column:
    """Entries of severity `most` or graver; 0 is no filter."""
    return F.col("severity") <= most if most > 0 else F.lit(True)


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): lines that were read, and the others with class and raw text."""
    return parsed.where(F.col("error_class").isNull()).drop("error_class"), parsed.where(F.col("error_class").isNotNull())
