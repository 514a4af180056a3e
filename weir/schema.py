"""The canonical record: its columns, severity names and error classes.

Inside DataFrames absence is the zero value ("" or 0) for facility, host, proc
and pid, and null for an unknown time; rendering turns zero values into absent
JSON keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severity names by number, and other spellings that decoding accepts.
LEVELS = ("emerg", "alert", "crit", "error", "warn", "notice", "info", "debug")
LEVEL_ALIASES = {"err": 3, "warning": 4}
UNKNOWN_LEVEL = "unknown"

INVALID_FORMAT = "INVALID_FORMAT"
TRUNCATED_LINE = "TRUNCATED_LINE"
INVALID_PRIORITY = "INVALID_PRIORITY"
OTHER = "OTHER"
ERROR_CLASSES = (INVALID_FORMAT, TRUNCATED_LINE, INVALID_PRIORITY, OTHER)

#: Largest PRI value: facility 23, severity 7.
MAX_PRIORITY = 191

RECORD = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_ns", T.ShortType()),  # nanoseconds below the microsecond
        T.StructField("ts_offset_s", T.IntegerType()),  # zone of the original text
        T.StructField("severity", T.ByteType()),
        T.StructField("level", T.StringType()),
        T.StructField("facility", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("proc", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("msg", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
COLUMNS = tuple(RECORD.fieldNames())


def level_name(severity: Column) -> Column:
    """The name of a severity; out of range or null: unknown."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in LEVELS]), severity.cast("int")), F.lit(UNKNOWN_LEVEL))


def level_number(text: Column) -> Column:
    """The severity of a name, an alias or a digit 0 to 7; null for anything else."""
    known = {name: k for k, name in enumerate(LEVELS)} | LEVEL_ALIASES | {str(k): k for k in range(8)}
    table = F.create_map(*[x for name, k in known.items() for x in (F.lit(name), F.lit(k).cast("byte"))])
    return F.try_element_at(table, text)


def parsed_severity(severity: Column) -> Column:
    """A parsed severity; out of range it counts as a warning."""
    return F.when(severity.between(0, 7), severity).otherwise(F.lit(4)).cast("byte")


def no_fields() -> Column:
    return F.expr("cast(map() as map<string,string>)")
