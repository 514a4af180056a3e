"""RFC 5424 lines: <PRI>VERSION TIMESTAMP HOST APP PROCID MSGID STRUCTURED-DATA message."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir import schema
from weir.functions import text, times
from weir.operators.parsers.registry import finish, register

# Bracket blocks, in which a backslash covers the next character and quotes cover brackets.
# Possessive throughout, so that long values take no stack.
_BLOCKS = r"""(?s)^(?:\[(?:[^"\\\]]++|\\.|"(?:[^"\\]++|\\.)*+")*+\])++"""
_HEADER = 6
_MARK = "\ufeff"  # byte order mark before a message in UTF-8


class SyslogRFC5424:
    """No options."""

    name = "syslog_rfc5424"

    def __init__(self, options: dict[str, Any]):
        pass

    def parse(self, df: DataFrame, value: str = "value") -> DataFrame:
        df = text.split_priority(df.withColumn("_line", text.trim_newline(F.col(value))), "_line")
        df = df.withColumn("_parts", F.split("_rest", " ", _HEADER + 1))
        part = lambda k: F.get("_parts", F.lit(k))
        valid, ts, ns, offset = times.rfc3339(F.col("_stamp"))
        df = df.withColumn("_stamp", part(1)).withColumns({"_dash": F.col("_stamp") == "-", "_valid": valid, "_ts": ts, "_ns": ns, "_offset": offset, "_body": F.coalesce(part(_HEADER), F.lit(""))})
        df = df.withColumn("_sd", F.when(F.startswith("_body", F.lit("[")), F.regexp_extract("_body", _BLOCKS, 0)).otherwise(F.left(F.col("_body"), F.lit(1))))
        after = F.substr(F.col("_body"), F.char_length("_sd") + 1)
        # Tokens in order: an empty one before a space is malformed, the end of the line where one is due is truncation.
        error = F.when(F.coalesce(F.col("_line"), F.lit("")) == "", schema.TRUNCATED_LINE).when(F.col("_pri_error").isNotNull(), F.col("_pri_error"))
        for k in range(_HEADER):
            last = F.size("_parts") == k + 1
            error = error.when(part(k).isNull() | (part(k) == "") & last, schema.TRUNCATED_LINE).when(part(k) == "", schema.INVALID_FORMAT)
            if k == 1:
                error = error.when(~F.col("_dash") & ~F.col("_valid"), schema.INVALID_FORMAT)
        # A block not closed leaves a bracket: nothing was matched, or another block begins after the match.
        error = error.when(F.col("_body") == "", schema.TRUNCATED_LINE).when((F.col("_sd") == "") | ~F.left(F.col("_sd"), F.lit(1)).isin("-", "[") | F.startswith("_sd", F.lit("[")) & F.startswith("_after", F.lit("[")), schema.INVALID_FORMAT)
        df = df.withColumn("_after", after).withColumn("_error0", error)
        message = F.when(F.startswith("_after", F.lit(" ")), F.substr(F.col("_after"), F.lit(2))).otherwise(F.col("_after"))
        return finish(
            df, self.name, F.col("_error0"),
            ts=F.col("_ts"), ts_ns=F.coalesce("_ns", F.lit(0)), ts_offset_s=F.coalesce("_offset", F.lit(0)),
            severity=schema.parsed_severity(F.col("_pri") % 8), facility=F.floor(F.col("_pri") / 8),
            host=text.dash_is_empty(part(2)), proc=text.dash_is_empty(part(3)), pid=F.coalesce(text.integer(part(4)), F.lit(0)),
            msg=F.when(F.startswith(message, F.lit(_MARK)), F.substr(message, F.lit(2))).otherwise(message),
            fields=F.when(F.col("_sd") == "-", schema.no_fields()).otherwise(F.create_map(F.lit("structured_data"), F.col("_sd"))),
        )


register(SyslogRFC5424.name, SyslogRFC5424)
