"""Records as JSON lines and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir import schema
from weir.functions import times

#: What the lines hold; level may be a name, an alias or a digit, quoted or bare.
WIRE = T.StructType([T.StructField(n, t) for n, t in (("ts", T.StringType()), ("level", T.StringType()), ("facility", T.LongType()), ("host", T.StringType()), ("proc", T.StringType()), ("pid", T.LongType()), ("msg", T.StringType()), ("src", T.StringType()), ("fields", T.MapType(T.StringType(), T.StringType())))])


def to_json() -> Column:
    """One line of JSON: ts, level, msg and src always, the others unless zero; keys of fields sorted."""
    present = lambda c, zero: F.when(F.col(c) != zero, F.col(c)).alias(c)
    fields = F.map_from_entries(F.array_sort(F.map_entries("fields")))
    line = F.to_json(F.struct(
        times.render(F.col("ts"), F.col("ts_ns"), F.col("ts_offset_s")).alias("ts"), schema.level_name(F.col("severity")).alias("level"), present("facility", 0), present("host", ""), present("proc", ""), present("pid", 0),
        F.coalesce("msg", F.lit("")).alias("msg"), F.coalesce("src", F.lit("")).alias("src"), F.when(F.size("fields") > 0, fields).alias("fields"),
    ))
    # Line separators inside strings are escaped, as readers that split on them expect.
    return F.replace(F.replace(line, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))


def from_wire(df: DataFrame) -> DataFrame:
    """Canonical records of read lines (WIRE columns); error_class where ts or level cannot be read."""
    severity = schema.level_number(F.col("level"))
    valid, ts, ns, offset = times.rfc3339(F.col("ts"))
    return df.select(
        F.when(F.col("ts") != times.ZERO_TIME, ts).alias("ts"), F.coalesce(ns, F.lit(0)).cast("short").alias("ts_ns"), F.coalesce(offset, F.lit(0)).cast("int").alias("ts_offset_s"), severity.alias("severity"), schema.level_name(severity).alias("level"),
        F.coalesce("facility", F.lit(0)).cast("long").alias("facility"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("proc", F.lit("")).alias("proc"), F.coalesce("pid", F.lit(0)).cast("long").alias("pid"), F.coalesce("msg", F.lit("")).alias("msg"), F.coalesce("src", F.lit("")).alias("src"),
        F.coalesce("fields", schema.no_fields()).alias("fields"), F.when(severity.isNull() | ~valid, schema.INVALID_FORMAT).alias("error_class"),
    )


def from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Canonical records of JSON lines in a column."""
    return from_wire(df.select(F.from_json(F.col(value), WIRE).alias("r")).select("r.*"))
