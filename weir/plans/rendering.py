"""Log lines rendered from the test tables, which hold no raw log text.

Each format corrupts some rows by event_id, so that every error class occurs;
what a row should parse to follows from its columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Zone offsets of rendered RFC 5424 stamps, by event_id.
ZONES = (("Z", 0), ("+02:00", 7200), ("-05:30", -19800))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as an instant in UTC, cents, and the PRI value of rendered lines.

    A table of fewer files than cores is dealt out to all of them.
    """
    read = spark.read.parquet(f"{sf_dir}/events.parquet")
    if len(read.inputFiles()) < spark.sparkContext.defaultParallelism:
        read = read.repartition(spark.sparkContext.defaultParallelism)
    return read.withColumns({"at": F.col("ts").cast("timestamp"), "cents": F.round(F.col("value") * 100).cast("bigint"), "pri": F.col("event_id") % 192})


def _pick(pairs, otherwise):
    """A column of the first text whose divisor divides event_id."""
    out = None
    for divisor, text in pairs:
        out = F.when(F.col("event_id") % divisor == 0, text) if out is None else out.when(F.col("event_id") % divisor == 0, text)
    return out.otherwise(otherwise)


def bsd(df: DataFrame) -> DataFrame:
    stamp = F.concat(F.date_format("at", "MMM "), F.lpad(F.dayofmonth("at").cast("string"), 2, " "), F.date_format("at", " HH:mm:ss"))
    line = F.format_string("<%d>%s host%d %s[%d]: value=%d", "pri", stamp, F.col("user_id") % 50, "event_type", "user_id", "cents")
    return df.withColumn("value", _pick([(97, F.concat(F.lit("x"), line)), (89, F.concat(F.lit("<999>"), stamp)), (83, F.lit("<13>")), (79, F.concat(F.lit("<13>Feb 30 "), F.lit("00:00:00 h p: m")))], F.concat(line, F.when(F.col("event_id") % 2 == 0, "\r\n").otherwise("\n"))))


def rfc5424(df: DataFrame) -> DataFrame:
    zone, shift = F.lit(""), F.lit(0)
    for k, (text, seconds) in enumerate(ZONES):
        zone, shift = F.when(F.col("event_id") % 3 == k, text).otherwise(zone), F.when(F.col("event_id") % 3 == k, seconds).otherwise(shift)
    local = F.timestamp_micros(F.unix_micros("at") + shift.cast("bigint") * 1_000_000)
    stamp = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    block = F.concat(F.lit('[meta@1 props="'), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"]'))
    line = F.concat(F.format_string("<%d>1 ", "pri"), F.when(F.col("event_id") % 61 == 0, "-").otherwise(stamp), F.format_string(" host%d %s %d ID%d ", F.col("user_id") % 50, "event_type", "user_id", "event_id"), F.when(F.col("event_id") % 5 == 0, "-").otherwise(block), F.format_string(" value=%d", "cents"))
    return df.withColumn("value", _pick([(97, F.lit("1 - - - - - - m")), (89, F.lit("<13>1 2024-13-01T00:00:00Z h a - - - m")), (83, F.lit("<13>1 - - - - - [oops m")), (79, F.lit("<13>1 - host"))], line))


def kmsg(df: DataFrame) -> DataFrame:
    micros = F.unix_micros("at") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    line = F.concat(F.format_string("%d,%d,", "pri", "event_id"), micros.cast("string"), F.when(F.col("event_id") % 4 == 0, ",c;").when(F.col("event_id") % 4 == 1, ",-,x=1;").otherwise(",-;"), F.format_string("%s value=%d", "event_type", "cents"))
    return df.withColumn("value", _pick([(97, F.lit("6,1,1,- no end")), (89, F.lit("999,1,1,-;m")), (83, F.lit("6,1,x,-;m")), (79, F.lit(""))], line))


def dmesg_legacy(df: DataFrame) -> DataFrame:
    micros = F.unix_micros("at") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    line = F.concat(F.lit("["), F.lpad(F.concat(F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0")), 14, " "), F.lit("]  "), F.format_string("%s value=%d", "event_type", "cents"))
    return df.withColumn("value", _pick([(97, F.lit("no bracket")), (89, F.lit("[1e30] m")), (83, F.lit("[] m")), (79, F.lit("\n"))], line))


def dmesg_iso(df: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss,SSSSSS"), F.lit("+0000] "), F.format_string("%s value=%d", "event_type", "cents"))
    return df.withColumn("value", _pick([(97, F.lit("[2024-01-01T00:00:00Z] m")), (89, F.lit("[nope m"))], line))


def journald(conversations: DataFrame) -> DataFrame:
    """Records of conversations: text with spaces for line ends, and a unit by conversation."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ")
    lines = [F.concat(F.lit("MESSAGE="), text), F.format_string("PRIORITY=%d", F.col("turn") % 9), F.format_string("_HOSTNAME=host%d", F.col("conv_id") % 50), F.format_string("_PID=%d", F.col("conv_id")), F.concat(F.lit("_COMM="), F.col("role")), F.lit("BINARY"), F.format_string("SYSLOG_FACILITY=%d", F.col("conv_id") % 24), F.format_string("__REALTIME_TIMESTAMP=%d", F.lit(1_704_067_200_000_000) + F.col("conv_id") * 1_000_003 + F.col("turn")), F.format_string("_SYSTEMD_UNIT=unit%d.service", F.col("conv_id") % 7)]
    return conversations.withColumn("value", F.concat_ws("\n", *lines))
