"""Kernel ring-buffer records: PRI,SEQ,USEC,FLAG[,...];message."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir import schema
from weir.functions import text, times
from weir.operators.parsers.registry import finish, register

#: Microseconds whose nanoseconds still fit 64 bits.
MAX_MICROS = (2**63 - 1) // 1000


def boot_time(uptime: str = "/proc/uptime") -> datetime | None:
    """When this machine started, or None where that cannot be read."""
    try:
        seconds = float(Path(uptime).read_text().split()[0])
    except (OSError, ValueError, IndexError):
        return None
    return datetime.now(UTC) - timedelta(seconds=seconds)


def boot_option(options: dict[str, Any]) -> datetime | None:
    """The boot_time option (an RFC 3339 text), or this machine's."""
    given = options.get("boot_time")
    return times.parse_rfc3339(given) if isinstance(given, str) and given else boot_time()


class KMsg:
    """boot_time: RFC 3339 text that times count from."""

    name = "kmsg"

    def __init__(self, options: dict[str, Any]):
        self.boot = boot_option(options)

    def parse(self, df: DataFrame, value: str = "value") -> DataFrame:
        df = df.withColumn("_line", text.trim_newline(F.col(value))).withColumn("_semi", F.instr("_line", ";"))
        df = df.withColumn("_parts", F.split(F.left(F.col("_line"), F.col("_semi") - 1), ",", 5))
        part = lambda k: F.get("_parts", F.lit(k))
        df = df.withColumns({"_pri": text.integer(part(0)), "_usec": text.integer(part(2)), "_flag": part(3)})
        error = (
            F.when(F.coalesce(F.col("_line"), F.lit("")) == "", schema.TRUNCATED_LINE)
            .when((F.col("_semi") == 0) | (F.size("_parts") < 4), schema.INVALID_FORMAT)
            .when(F.col("_pri").isNull() | ~F.col("_pri").between(0, schema.MAX_PRIORITY), schema.INVALID_PRIORITY)
            .when(F.col("_usec").isNull() | ~F.col("_usec").between(0, MAX_MICROS), schema.INVALID_FORMAT)
        )
        df = df.withColumn("_error0", error)
        return finish(
            df, self.name, F.col("_error0"),
            ts=times.plus_micros(self.boot, F.when(F.col("_error0").isNull(), F.col("_usec"))),
            severity=schema.parsed_severity(F.col("_pri") % 8), facility=F.floor(F.col("_pri") / 8), proc=F.lit("kernel"),
            msg=F.substr(F.col("_line"), F.col("_semi") + 1),
            fields=F.when(F.col("_flag").isin("", "-"), schema.no_fields()).otherwise(F.create_map(F.lit("flag"), F.col("_flag"), F.lit("seq"), part(1))),
        )


register(KMsg.name, KMsg)
