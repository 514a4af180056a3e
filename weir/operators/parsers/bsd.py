"""RFC 3164 lines: <PRI>Mmm dd hh:mm:ss host tag[pid]: message."""

from __future__ import annotations

from datetime import datetime
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir import schema
from weir.functions import text, times
from weir.operators.parsers.registry import finish, register

_STAMP = r"^[A-Za-z]{3} +([0-9]{1,2}) +([0-9]{1,2}):([0-9]{2}):([0-9]{2}(?:[.,][0-9]+)?)$"
_STAMP_BYTES = 15


class SyslogBSD:
    """default_year: of the stamps, which have none; timezone: theirs (None: the session's).

    strict is accepted for configurations that set it; it changes nothing.
    """

    name = "syslog_bsd"

    def __init__(self, options: dict[str, Any]):
        year, zone = options.get("default_year"), options.get("timezone")
        self.year = year if isinstance(year, int) and not isinstance(year, bool) and year else datetime.now().year
        self.zone = zone if isinstance(zone, str) and zone else None
        if self.zone:
            ZoneInfo(self.zone)  # an unknown zone is an error here, not in the query

    def parse(self, df: DataFrame, value: str = "value") -> DataFrame:
        df = text.split_priority(df.withColumn("_line", text.trim_newline(F.col(value))), "_line")
        stamp = F.left(F.col("_rest"), F.lit(_STAMP_BYTES))
        df = df.withColumns({"_stamp": stamp, "_stamped": stamp.rlike(_STAMP), "_tail": F.substr(F.col("_rest"), F.lit(_STAMP_BYTES + 1))})
        at = lambda place, n: F.substr(F.col("_stamp"), F.lit(place), F.lit(n))
        usual = (at(7, 1) == " ") & (at(10, 1) == ":") & (at(13, 1) == ":")
        part = lambda k, place: F.trim(F.when(usual, at(place, 2)).otherwise(F.regexp_extract("_stamp", _STAMP, k)))
        month = F.instr(F.lit("".join(times.MONTHS)), F.lower(at(1, 3))) + 2
        df = df.withColumns({
            "_month": F.when(month % 3 == 0, F.floor(month / 3).cast("int")).otherwise(0), "_day": part(1, 5).try_cast("int"), "_hour": part(2, 8).try_cast("int"), "_minute": part(3, 11).try_cast("int"),
            "_micros": F.when(usual, at(14, 2).try_cast("bigint") * 1_000_000).otherwise((F.replace(F.regexp_extract("_stamp", _STAMP, 4), F.lit(","), F.lit(".")).try_cast("decimal(8,6)") * 1_000_000).cast("bigint")),
            "_after": F.substr(F.col("_tail"), F.lit(2)),
        }).withColumn("_space", F.instr("_after", " "))
        # The day is held against a leap year, and the 29th of February of another year is the 1st of March.
        last = F.when(F.col("_month") == 2, 29).when(F.col("_month").isin(4, 6, 9, 11), 30).otherwise(31)
        dated = F.coalesce(F.col("_stamped") & (F.col("_month") > 0) & F.col("_day").between(1, last) & (F.col("_hour") < 24) & (F.col("_minute") < 60) & (F.col("_micros") < 60_000_000), F.lit(False))
        error = (
            F.when(F.coalesce(F.col("_line"), F.lit("")) == "", schema.TRUNCATED_LINE)
            .when(F.col("_pri_error").isNotNull(), F.col("_pri_error"))
            .when(F.octet_length("_rest") < _STAMP_BYTES, schema.TRUNCATED_LINE)
            .when(~dated | ~F.startswith("_tail", F.lit(" ")) | (F.col("_space") < 2), schema.INVALID_FORMAT)
        )
        day = F.date_add(F.make_date(F.lit(self.year), F.greatest(F.col("_month"), F.lit(1)), F.lit(1)), F.col("_day") - 1)
        wall = F.unix_date(day).cast("bigint") * 86_400_000_000 + (F.col("_hour") * 3600 + F.col("_minute") * 60).cast("bigint") * 1_000_000 + F.col("_micros")
        zone = self.zone or df.sparkSession.conf.get("spark.sql.session.timeZone")
        df = df.withColumns({"_error0": error, "_body": F.substr(F.col("_after"), F.col("_space") + 1)}).withColumn("_wall", F.when(F.col("_error0").isNull(), F.timestamp_micros(wall)))
        df = df.withColumns({"_ts": F.col("_wall") if zone == "UTC" else F.to_utc_timestamp("_wall", zone), "_tag": F.substring_index(F.substring_index(F.substring_index("_body", "[", 1), ":", 1), " ", 1)})
        df = df.withColumn("_post", F.substr(F.col("_body"), F.char_length("_tag") + 1)).withColumn("_close", F.instr("_post", "]"))
        bracket = F.startswith("_post", F.lit("[")) & (F.col("_close") > 0)
        message = F.when(bracket, F.substr(F.col("_post"), F.col("_close") + 1)).otherwise(F.col("_post"))
        return finish(
            df, self.name, F.col("_error0"),
            ts=F.col("_ts"), ts_offset_s=F.unix_seconds("_wall") - F.unix_seconds("_ts"),
            severity=schema.parsed_severity(F.col("_pri") % 8), facility=F.floor(F.col("_pri") / 8),
            host=F.substring_index("_after", " ", 1), proc=F.col("_tag"),
            pid=F.when(bracket, text.nonnegative(F.substr(F.col("_post"), F.lit(2), F.greatest(F.col("_close") - 2, F.lit(0))))).otherwise(0),
            msg=F.ltrim(F.when(F.startswith(message, F.lit(":")), F.substr(message, F.lit(2))).otherwise(message)),
        )


register(SyslogBSD.name, SyslogBSD)
