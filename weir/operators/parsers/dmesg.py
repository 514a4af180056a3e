"""dmesg text: [seconds since boot or ISO time] message."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir import schema
from weir.functions import text, times
from weir.operators.parsers.kmsg import boot_option
from weir.operators.parsers.registry import finish, register

_ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2})[.,]([0-9]{6})([+-][0-9]{2})([0-9]{2})$"
_SECONDS = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Whole seconds whose nanoseconds fit 64 bits.
MAX_SECONDS = 9_223_372_036.0


class Dmesg:
    """boot_time: RFC 3339 text that seconds count from."""

    name = "dmesg"

    def __init__(self, options: dict[str, Any]):
        self.boot = boot_option(options)

    def parse(self, df: DataFrame, value: str = "value") -> DataFrame:
        df = df.withColumn("_line", text.trim_newline(F.col(value))).withColumn("_close", F.instr("_line", "]"))
        stamp = F.regexp_replace(F.substr(F.col("_line"), F.lit(2), F.greatest(F.col("_close") - 2, F.lit(0))), r"^\s+|\s+$", "")
        df = df.withColumn("_stamp", stamp).withColumn("_iso", F.instr("_stamp", "T") > 1)
        # The ISO form differs from RFC 3339 by its comma and a zone without colon.
        strict = F.when(F.col("_stamp").rlike(_ISO), F.regexp_replace("_stamp", _ISO, "$1.$2$3:$4"))
        df = df.withColumn("_strict", strict)
        valid, ts, _, offset = times.rfc3339(F.col("_strict"))
        df = df.withColumns({"_valid": F.coalesce(valid, F.lit(False)), "_ts": ts, "_offset": offset, "_seconds": F.when(F.col("_stamp").rlike(_SECONDS), F.col("_stamp").try_cast("double"))})
        error = (
            F.when(F.coalesce(F.col("_line"), F.lit("")) == "", schema.TRUNCATED_LINE)
            .when(~F.startswith("_line", F.lit("[")) | (F.col("_close") == 0) | (F.col("_stamp") == ""), schema.INVALID_FORMAT)
            .when(F.col("_iso") & ~F.col("_valid"), schema.OTHER)
            .when(~F.col("_iso") & (F.col("_seconds").isNull() | (F.col("_seconds") < 0) | (F.col("_seconds") > MAX_SECONDS)), schema.INVALID_FORMAT)
        )
        df = df.withColumn("_error0", error).withColumn("_nanos", F.when(F.col("_error0").isNull() & ~F.col("_iso"), (F.col("_seconds") * 1e9).cast("bigint")))
        since_boot = times.plus_micros(self.boot, F.expr("_nanos div 1000"))
        return finish(
            df, self.name, F.col("_error0"),
            ts=F.when(F.col("_iso"), F.col("_ts")).otherwise(since_boot),
            ts_ns=F.when(F.col("_iso") | F.lit(self.boot is None), 0).otherwise(F.col("_nanos") % 1000), ts_offset_s=F.coalesce("_offset", F.lit(0)),
            severity=F.lit(6).cast("byte"), proc=F.lit("kernel"),
            msg=F.regexp_replace(F.substr(F.col("_line"), F.col("_close") + 1), "^[ \\t]+", ""),
        )


register(Dmesg.name, Dmesg)
