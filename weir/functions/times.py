"""Timestamps of log formats, durations, and their rendering."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZERO_TIME = "0001-01-01T00:00:00Z"

_RFC3339 = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{1,2}):([0-9]{2}):([0-9]{2})([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339(text: Column) -> tuple[Column, Column, Column, Column]:
    """(valid, ts, ts_ns, ts_offset_s) of a strict RFC 3339 timestamp with any number of decimals.

    One match settles the shape; the parts are then cut out by place, and the cast settles the calendar.
    """
    utc = F.endswith(text, F.lit("Z"))
    zone = F.when(utc, F.lit("Z")).otherwise(F.right(text, F.lit(6)))
    wall = F.left(text, F.char_length(text) - F.char_length(zone))
    # The fraction at nine digits; more are cut off, and the cast takes the first six.
    point = F.locate(".", F.replace(wall, F.lit(","), F.lit(".")), 15)
    low = F.when(point > 0, F.rpad(F.substr(wall, point + 7, F.lit(3)), 3, "0")).otherwise("0")
    hours, minutes = F.substr(zone, F.lit(2), F.lit(2)).try_cast("int"), F.substr(zone, F.lit(5), F.lit(2)).try_cast("int")
    offset = F.when(utc, 0).otherwise((hours * 3600 + minutes * 60) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1))
    moment = F.when(text.rlike(_RFC3339), F.concat(F.replace(wall, F.lit(","), F.lit(".")), F.lit("Z")).try_cast("timestamp"))
    valid = moment.isNotNull() & (utc | (hours <= 24) & (minutes < 60))
    ts = F.timestamp_micros(F.unix_micros(moment) - F.lit(1_000_000).cast("bigint") * offset)
    return valid, F.when(valid, ts), F.when(valid, low.try_cast("short")), F.when(valid, offset)


def plus_micros(moment: datetime | None, micros: Column) -> Column:
    """A moment and microseconds after it; null for no moment."""
    if moment is None:
        return F.lit(None).cast("timestamp")
    return F.timestamp_micros(F.lit(unix_micros(moment)).cast("bigint") + micros)


def unix_micros(moment: datetime) -> int:
    """Microseconds since 1970 of a datetime; without zone it is taken as UTC."""
    moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    return (moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def render(ts: Column, ts_ns: Column, offset: Column) -> Column:
    """RFC 3339 text in the original zone with no trailing zeros in the fraction; null: the zero time."""
    shift = F.coalesce(offset, F.lit(0))
    local = F.timestamp_micros(F.unix_micros(ts) + F.lit(1_000_000).cast("bigint") * shift)
    nanos = F.concat(F.lpad(F.pmod(F.unix_micros(ts), F.lit(1_000_000)).cast("string"), 6, "0"), F.lpad(F.coalesce(ts_ns, F.lit(0)).cast("string"), 3, "0"))
    fraction = F.regexp_replace(nanos, "0+$", "")
    minutes = F.abs(shift) / 60
    zone = F.when(shift == 0, "Z").otherwise(F.concat(F.when(shift < 0, "-").otherwise("+"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(minutes) % 60).cast("string"), 2, "0")))
    return F.when(ts.isNull(), F.lit(ZERO_TIME)).otherwise(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), zone))


# Units of duration texts, in nanoseconds.
_UNITS = {"ns": 1, "us": 1000, "µs": 1000, "μs": 1000, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_DURATION = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def duration(text: str) -> timedelta:
    """A duration such as 250ms, 1h30m or -1.5s; finer than a microsecond is cut off."""
    sign, rest = (-1 if text[:1] == "-" else 1), text.removeprefix("-") if text[:1] == "-" else text.removeprefix("+")
    if rest == "0":
        return timedelta()
    at, total = 0, 0
    while at < len(rest):
        if not (m := _DURATION.match(rest, at)):
            raise ValueError(f"bad duration {text!r}")
        whole, _, part = m[1].partition(".")
        unit = _UNITS[m[2]]
        total += int(whole or 0) * unit + (int(part) * unit // 10 ** len(part) if part else 0)
        at = m.end()
    if not rest or total >= 1 << 63:
        raise ValueError(f"bad duration {text!r}")
    return sign * timedelta(microseconds=total // 1000)


_RFC3339_TEXT = re.compile(r"(\d{4}-\d{2}-\d{2}T)(\d{1,2})(:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})")


def parse_rfc3339(text: str) -> datetime:
    """A strict RFC 3339 timestamp on the driver; finer than a microsecond is cut off."""
    m = _RFC3339_TEXT.fullmatch(text)
    if not m:
        raise ValueError(f"bad RFC 3339 time {text!r}")
    return datetime.fromisoformat(f"{m[1]}{m[2]:0>2}{m[3]}.{(m[4] or '')[:6]:0<6}{'+00:00' if m[5] == 'Z' else m[5]}")
