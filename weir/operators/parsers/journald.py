"""journalctl export records: KEY=value lines."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir import schema
from weir.functions import text
from weir.operators.parsers.registry import finish, register

_ROUTED = ("MESSAGE", "PRIORITY", "_HOSTNAME", "_PID", "SYSLOG_IDENTIFIER", "_COMM", "SYSLOG_FACILITY", "__REALTIME_TIMESTAMP")


class Journald:
    """No options."""

    name = "journald"

    def __init__(self, options: dict[str, Any]):
        pass

    def parse(self, df: DataFrame, value: str = "value") -> DataFrame:
        lines = F.filter(F.split(F.col(value), "\n"), lambda x: F.instr(x, "=") > 1)
        pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substr(x, F.instr(x, "=") + 1).alias("value")))
        df = df.withColumn("_pairs", pairs)

        def last(key: str, of=lambda v: v) -> Column:
            """The last value of a key that can be read."""
            read = F.filter(F.transform(F.filter("_pairs", lambda p: p["key"] == key), lambda p: of(p["value"])), lambda v: v.isNotNull())
            return F.try_element_at(read, F.lit(-1))

        others = F.filter("_pairs", lambda p: ~p["key"].isin(*_ROUTED))
        df = df.withColumns({
            "_msg": F.coalesce(last("MESSAGE"), F.lit("")),
            "_priority": last("PRIORITY", lambda v: F.when(text.integer(v).between(0, 7), text.integer(v))),
            "_named": F.filter("_pairs", lambda p: p["key"].isin("SYSLOG_IDENTIFIER", "_COMM")),
            "_others": others,
        })
        # An identifier always names the process, a command only one without a name so far.
        process = F.aggregate("_named", F.lit(""), lambda name, p: F.when((p["key"] == "SYSLOG_IDENTIFIER") | (name == ""), p["value"]).otherwise(name))
        # Of a key that repeats, the last value stays.
        latest = F.filter("_others", lambda p, i: ~F.exists(F.slice("_others", i + 2, F.size("_others")), lambda q: q["key"] == p["key"]))
        empty = F.coalesce(F.col(value), F.lit("")) == ""
        error = F.when(empty, schema.TRUNCATED_LINE).when((F.col("_msg") == "") & (F.size("_others") == 0), schema.INVALID_FORMAT)
        return finish(
            df, self.name, error,
            ts=F.timestamp_micros(last("__REALTIME_TIMESTAMP", text.integer)),
            severity=F.coalesce(F.col("_priority"), F.lit(0)).cast("byte"), facility=F.coalesce(last("SYSLOG_FACILITY", text.integer), F.lit(0)),
            host=F.coalesce(last("_HOSTNAME"), F.lit("")), proc=process, pid=F.coalesce(last("_PID", text.integer), F.lit(0)),
            msg=F.col("_msg"), fields=F.map_from_entries(latest),
        )


register(Journald.name, Journald)
