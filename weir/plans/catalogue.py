"""Queries over the test tables, with the SQL that must give the same rows.

The SQL works the expected columns out of the tables directly, without any log
line, so it does not depend on the parsers.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir import schema
from weir.functions import jsonl, text
from weir.operators import parsers, ratelimit, retention
from weir.operators.filters import TimeRange, journal_priority, journal_units
from weir.operators.merge import merge, positions
from weir.plans import checks, rendering
from weir.sinks import topics

BOOT = "2024-01-01T00:00:00Z"
SINCE, UNTIL = datetime(2024, 1, 5, 12), datetime(2024, 1, 20)
OPTIONS = {"syslog_bsd": {"default_year": 2024, "timezone": "UTC"}, "syslog_rfc5424": {}, "kmsg": {"boot_time": BOOT}, "dmesg": {"boot_time": BOOT}, "journald": {}}
LINE_CAP, RING_ENTRIES, RING_BYTES, SPOOL_BYTES, BATCH = 2048, 2500, 100_000, 300_000, 100
RATE, BURST = 1 / 2400, 3

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(df: DataFrame, name: str) -> DataFrame:
    return parsers.build(name, OPTIONS[name]).parse(df)


def _ntz(c: str = "ts") -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


def _bsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rendering.bsd(rendering.events(spark, sf_dir).drop("ts")), "syslog_bsd")


def _rfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rendering.rfc5424(rendering.events(spark, sf_dir).drop("ts")), "syslog_rfc5424")


def _kmsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rendering.kmsg(rendering.events(spark, sf_dir).drop("ts")), "kmsg")


def _journald(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(rendering.journald(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "journald")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's whole shape: parse, time range, order, cap."""
    good = _bsd(spark, sf_dir).where(F.col("error_class").isNull()).withColumn("line_ord", F.col("event_id"))
    return merge([TimeRange(SINCE, UNTIL).apply(good)], max_lines=1000).select(_ntz(), "level", "facility", "host", "proc", "pid", "msg", "src")


def _shown(df: DataFrame, *more: Column | str) -> DataFrame:
    return df.select("event_id", _ntz(), F.col("severity").cast("bigint").alias("severity"), "level", "facility", "host", "proc", "pid", "msg", "error_class", *more)


def parse_syslog_bsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_bsd(spark, sf_dir))


def parse_syslog_rfc5424(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_rfc(spark, sf_dir), F.col("fields")["structured_data"].alias("sd"), F.col("ts_offset_s").cast("bigint").alias("ts_offset_s"))


def parse_kmsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_kmsg(spark, sf_dir), F.col("fields")["flag"].alias("flag"), F.col("fields")["seq"].alias("seq"))


def parse_dmesg_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _parsed(rendering.dmesg_legacy(rendering.events(spark, sf_dir).drop("ts")), "dmesg")
    # Seconds go through a double, so the last nanosecond may be one short: compared at the microsecond.
    near = F.timestamp_micros(F.unix_micros("ts") + (F.col("ts_ns") >= 500).cast("bigint"))
    return _shown(out.withColumn("ts", near))


def parse_dmesg_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_parsed(rendering.dmesg_iso(rendering.events(spark, sf_dir).drop("ts")), "dmesg"))


def parse_journald(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journald(spark, sf_dir).select("conv_id", "turn", _ntz(), F.col("severity").cast("bigint").alias("severity"), "level", "facility", "host", "proc", "pid", "msg", F.col("fields")["_SYSTEMD_UNIT"].alias("unit"), F.size("fields").cast("bigint").alias("n_fields"), "error_class")


def parse_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rendering.events(spark, sf_dir).drop("ts")
    every = None
    for name, render in (("syslog_bsd", rendering.bsd), ("syslog_rfc5424", rendering.rfc5424), ("kmsg", rendering.kmsg), ("dmesg", rendering.dmesg_iso)):
        part = _parsed(render(events), name).select("src", "error_class")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("src", F.coalesce("error_class", F.lit("OK")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


def _level_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(*[F.lit(x) for x in (*schema.LEVELS, "err", "warning", "3", "8", "chartreuse", "")])
    return rendering.events(spark, sf_dir).select("event_id", F.get(tokens, (F.col("event_id") % 14).cast("int")).alias("token"))


def level_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level_tokens(spark, sf_dir).withColumn("severity", schema.level_number(F.col("token")).cast("bigint"))


def level_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("event_id") % 10 - 1).alias("severity")
    return rendering.events(spark, sf_dir).select("event_id", number).withColumns({"level": schema.level_name(F.col("severity")), "parsed_level": schema.level_name(schema.parsed_severity(F.col("severity")))})


def filter_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TimeRange(SINCE, UNTIL).apply(_rfc(spark, sf_dir).where(F.col("error_class").isNull())).select("event_id", _ntz())


def filter_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _journald(spark, sf_dir).where(F.col("error_class").isNull())
    return good.where(journal_units(["unit1.service", "unit4.service"]) & journal_priority(4)).select("conv_id", "turn", F.col("severity").cast("bigint").alias("severity"), F.col("fields")["_SYSTEMD_UNIT"].alias("unit"))


def _three(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    out = []
    for k, read in enumerate((_bsd, _rfc, _kmsg)):
        out.append(read(spark, sf_dir).where((F.col("event_id") % 3 == k) & F.col("error_class").isNull()).withColumn("line_ord", F.col("event_id")))
    return out


def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position: the row's place as the merge delivers it, so that the order itself is compared."""
    return positions(merge(_three(spark, sf_dir))).select(F.col("line_ord").alias("event_id"), _ntz(), "src", F.col("src_ord").cast("bigint").alias("src_ord"), "msg", "position")


def merge_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(merge(_three(spark, sf_dir), max_lines=500)).select(F.col("line_ord").alias("event_id"), _ntz(), "src", F.col("src_ord").cast("bigint").alias("src_ord"), "msg", "position")


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _rfc(spark, sf_dir).where(F.col("error_class").isNull()).select(jsonl.to_json().alias("value"))
    back = jsonl.from_json(lines)
    return back.select(_ntz(), F.col("ts_offset_s").cast("bigint").alias("ts_offset_s"), F.col("severity").cast("bigint").alias("severity"), "level", "facility", "host", "proc", "pid", "msg", "src", F.col("fields")["structured_data"].alias("sd"), "error_class")


def line_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, cut = text.cap_line(F.concat(F.col("text"), F.lit("\n")), LINE_CAP)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length(kept).cast("bigint").alias("kept_bytes"), cut.alias("truncated"))


def utf8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with ill-formed bytes all over them: letters without their last byte, stray bytes around spaces and at the end."""
    stray, cut = (F.lit(x).cast("string") for x in (b"\xc3 \x9f", b"\xc3"))
    spoilt = F.concat(F.replace(F.replace("text", F.lit("ñ"), cut), F.lit(" "), stray), F.lit(b"\xf0\x9f").cast("string"))
    repaired = text.repair_utf8(spoilt)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.char_length(repaired).cast("bigint").alias("n_chars"), F.md5(repaired.cast("binary")).alias("digest"))


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rfc(spark, sf_dir).where(F.col("error_class").isNull()).withColumn("cost", text.entry_cost())


def entry_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costed(spark, sf_dir).select("event_id", "cost")


def ring_entry_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.ring(rendering.events(spark, sf_dir), "event_id", RING_ENTRIES).select("event_id")


def ring_byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.ring(_costed(spark, sf_dir).select("event_id", "cost"), "event_id", RING_ENTRIES, RING_BYTES, "cost").select("event_id", "cost")


def spool_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("name"), F.col("n_chars").alias("size"))
    return retention.spool(files, "name", "size", SPOOL_BYTES)


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.batches(rendering.events(spark, sf_dir).select("event_id"), "event_id", BATCH).select("event_id", "batch")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratelimit.limit(rendering.events(spark, sf_dir).drop("ts"), "event_type", "at", "event_id", RATE, BURST)


def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rate_limit(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("allowed")).alias("dropped"))
    return counts.select("source", "seen", "dropped")


def topic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenant = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type"))
    return rendering.events(spark, sf_dir).select("event_id", topics.topic(tenant, F.format_string("device-%03d", F.col("user_id"))).alias("topic"))


def queries() -> dict[str, Query]:
    named = (
        parse_syslog_bsd, parse_syslog_rfc5424, parse_kmsg, parse_dmesg_legacy, parse_dmesg_iso, parse_journald, parse_error_classes, level_decode, level_encode, filter_time_range, filter_journal, merge_sources, merge_limit,
        jsonl_roundtrip, line_cap, utf8_repair, entry_cost, ring_entry_cap, ring_byte_cap, spool_evict, batch_assign, rate_limit, drop_counts, topic_route,
    )
    return {f.__name__: f for f in named} | checks.queries()


# The same in SQL. e: what every event is rendered from; *_ok: its class, null where the line is well-formed.
_LEVEL = "(CASE {s} WHEN 0 THEN 'emerg' WHEN 1 THEN 'alert' WHEN 2 THEN 'crit' WHEN 3 THEN 'error' WHEN 4 THEN 'warn' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' WHEN 7 THEN 'debug' ELSE 'unknown' END)"
_E = "e AS (SELECT *, event_id % 192 AS pri, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def _class(*pairs: tuple[int, str]) -> str:
    return "CASE " + " ".join(f"WHEN event_id % {n} = 0 THEN '{c}'" for n, c in pairs) + " END"


_BSD_CLASS = _class((97, "INVALID_FORMAT"), (89, "INVALID_PRIORITY"), (83, "TRUNCATED_LINE"), (79, "INVALID_FORMAT"))
_RFC_CLASS = _class((97, "INVALID_FORMAT"), (89, "INVALID_FORMAT"), (83, "INVALID_FORMAT"), (79, "TRUNCATED_LINE"))
_KMSG_CLASS = _class((97, "INVALID_FORMAT"), (89, "INVALID_PRIORITY"), (83, "INVALID_FORMAT"), (79, "TRUNCATED_LINE"))
_LEGACY_CLASS = _class((97, "INVALID_FORMAT"), (89, "INVALID_FORMAT"), (83, "INVALID_FORMAT"), (79, "TRUNCATED_LINE"))
_ISO_CLASS = _class((97, "OTHER"), (89, "INVALID_FORMAT"))
_SD = """CASE WHEN event_id % 5 <> 0 THEN '[meta@1 props="' || replace(props, '"', '\\"') || '"]' END"""


def _expected(classes: str, columns: dict[str, str]) -> str:
    """A CTE p with event_id, error_class and columns, which are null in error."""
    shown = ", ".join(f"CASE WHEN error_class IS NULL THEN {sql} END AS {name}" for name, sql in columns.items())
    return f"WITH {_E}, c AS (SELECT *, {classes} AS error_class FROM e), p AS (SELECT event_id, error_class, {shown} FROM c)"


_PRI = {"severity": "pri % 8", "level": _LEVEL.format(s="pri % 8"), "facility": "pri // 8"}
_HOSTED = {"host": "'host' || (user_id % 50)", "proc": "event_type", "pid": "user_id", "msg": "'value=' || cents"}
_KERNEL = {"host": "''", "proc": "'kernel'", "pid": "CAST(0 AS BIGINT)", "msg": "event_type || ' value=' || cents"}
_DMESG = {"ts": "ts", "severity": "CAST(6 AS BIGINT)", "level": "'info'", "facility": "CAST(0 AS BIGINT)"} | _KERNEL
_P_BSD = _expected(_BSD_CLASS, {"ts": "date_trunc('second', ts)"} | _PRI | _HOSTED)
_P_RFC = _expected(_RFC_CLASS, {"ts": "CASE WHEN event_id % 61 <> 0 THEN ts END"} | _PRI | _HOSTED | {"sd": _SD, "ts_offset_s": "CAST(CASE WHEN event_id % 61 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 7200 WHEN event_id % 3 = 2 THEN -19800 ELSE 0 END AS BIGINT)"})
_P_KMSG = _expected(_KMSG_CLASS, {"ts": "ts"} | _PRI | _KERNEL | {"flag": "CASE WHEN event_id % 4 = 0 THEN 'c' END", "seq": "CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) END"})
_MESSAGE = "regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g')"
_SEVERITY = "CASE WHEN turn % 9 <= 7 THEN turn % 9 ELSE 0 END"
_COST = "64 + strlen(msg) + strlen(host) + strlen(proc) + strlen('syslog_rfc5424') + CASE WHEN sd IS NULL THEN 0 ELSE strlen('structured_data') + strlen(sd) + 8 END"
_P_THREE = f"""WITH {_E}, m AS (
 SELECT event_id, date_trunc('second', ts) AS ts, 'syslog_bsd' AS src, CAST(0 AS BIGINT) AS src_ord, 'value=' || cents AS msg FROM e WHERE event_id % 3 = 0 AND ({_BSD_CLASS}) IS NULL
 UNION ALL SELECT event_id, CASE WHEN event_id % 61 <> 0 THEN ts END, 'syslog_rfc5424', CAST(1 AS BIGINT), 'value=' || cents FROM e WHERE event_id % 3 = 1 AND ({_RFC_CLASS}) IS NULL
 UNION ALL SELECT event_id, ts, 'kmsg', CAST(2 AS BIGINT), event_type || ' value=' || cents FROM e WHERE event_id % 3 = 2 AND ({_KMSG_CLASS}) IS NULL)"""
_BUCKETS = f"""WITH RECURSIVE n AS (SELECT event_type AS source, event_id AS seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
 b AS (SELECT source, seq, k, us AS last, CAST({BURST} AS DOUBLE) - 1 AS tokens, TRUE AS allowed FROM n WHERE k = 1
 UNION ALL SELECT source, seq, k, last, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END, filled >= 1 FROM (
  SELECT n.source, n.seq, n.k, greatest(n.us, b.last) AS last, CASE WHEN n.us > b.last THEN least(CAST({BURST} AS DOUBLE), b.tokens + CAST(n.us - b.last AS DOUBLE) / 1000000.0::DOUBLE * CAST({RATE!r} AS DOUBLE)) ELSE b.tokens END AS filled FROM b JOIN n ON n.source = b.source AND n.k = b.k + 1))"""


def oracle_sql() -> dict[str, str]:
    counts = " UNION ALL ".join(f"SELECT '{src}' AS src, coalesce({classes}, 'OK') AS error_class FROM events" for src, classes in (("syslog_bsd", _BSD_CLASS), ("syslog_rfc5424", _RFC_CLASS), ("kmsg", _KMSG_CLASS), ("dmesg", _ISO_CLASS)))
    tokens = ", ".join(f"'{x}'" for x in (*schema.LEVELS, "err", "warning", "3", "8", "chartreuse", ""))
    common = "event_id, ts, severity, level, facility, host, proc, pid, msg"
    return {
        "parse_syslog_bsd": f"{_P_BSD} SELECT {common}, error_class FROM p",
        "parse_syslog_rfc5424": f"{_P_RFC} SELECT {common}, error_class, sd, ts_offset_s FROM p",
        "parse_kmsg": f"{_P_KMSG} SELECT {common}, error_class, flag, seq FROM p",
        "parse_dmesg_legacy": f"{_expected(_LEGACY_CLASS, _DMESG)} SELECT {common}, error_class FROM p",
        "parse_dmesg_iso": f"{_expected(_ISO_CLASS, _DMESG)} SELECT {common}, error_class FROM p",
        "parse_journald": f"SELECT conv_id, turn, make_timestamp(1704067200000000 + conv_id * 1000003 + turn) AS ts, {_SEVERITY} AS severity, {_LEVEL.format(s=_SEVERITY)} AS level, conv_id % 24 AS facility, 'host' || (conv_id % 50) AS host, role AS proc, conv_id AS pid, {_MESSAGE} AS msg, 'unit' || (conv_id % 7) || '.service' AS unit, CAST(1 AS BIGINT) AS n_fields, CAST(NULL AS VARCHAR) AS error_class FROM conversations",
        "parse_error_classes": f"SELECT src, error_class, count(*) AS n FROM ({counts}) GROUP BY ALL",
        "level_decode": f"SELECT event_id, t AS token, CAST(CASE t WHEN 'emerg' THEN 0 WHEN 'alert' THEN 1 WHEN 'crit' THEN 2 WHEN 'error' THEN 3 WHEN 'err' THEN 3 WHEN '3' THEN 3 WHEN 'warn' THEN 4 WHEN 'warning' THEN 4 WHEN 'notice' THEN 5 WHEN 'info' THEN 6 WHEN 'debug' THEN 7 END AS BIGINT) AS severity FROM (SELECT event_id, list_extract([{tokens}], event_id % 14 + 1) AS t FROM events)",
        "level_encode": f"SELECT event_id, s AS severity, {_LEVEL.format(s='s')} AS level, {_LEVEL.format(s='CASE WHEN s BETWEEN 0 AND 7 THEN s ELSE 4 END')} AS parsed_level FROM (SELECT event_id, event_id % 10 - 1 AS s FROM events)",
        "filter_time_range": f"{_P_RFC} SELECT event_id, ts FROM p WHERE error_class IS NULL AND ts BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'",
        "filter_journal": f"SELECT conv_id, turn, {_SEVERITY} AS severity, 'unit' || (conv_id % 7) || '.service' AS unit FROM conversations WHERE conv_id % 7 IN (1, 4) AND {_SEVERITY} <= 4",
        "merge_sources": f"{_P_THREE} SELECT event_id, ts, src, src_ord, msg, row_number() OVER (ORDER BY ts ASC NULLS FIRST, src_ord, event_id) AS position FROM m",
        "merge_limit": f"{_P_THREE} SELECT event_id, ts, src, src_ord, msg, row_number() OVER (ORDER BY ts ASC NULLS FIRST, src_ord, event_id) AS position FROM m ORDER BY position LIMIT 500",
        "jsonl_roundtrip": f"{_P_RFC} SELECT ts, ts_offset_s, severity, level, facility, host, proc, pid, msg, 'syslog_rfc5424' AS src, sd, error_class FROM p WHERE error_class IS NULL",
        "line_cap": f"SELECT doc_id, CAST(least(strlen(text) + 1, {LINE_CAP}) AS BIGINT) AS kept_bytes, strlen(text) >= {LINE_CAP} AS truncated FROM documents",
        "utf8_repair": "SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(replace(replace(text, 'ñ', '�'), ' ', '� �') || '�', '�+', '�', 'g') AS t FROM documents)",
        "entry_cost": f"{_P_RFC} SELECT event_id, CAST({_COST} AS BIGINT) AS cost FROM p WHERE error_class IS NULL",
        "ring_entry_cap": f"SELECT event_id FROM events ORDER BY event_id DESC LIMIT {RING_ENTRIES}",
        "ring_byte_cap": f"{_P_RFC}, q AS (SELECT event_id, CAST({_COST} AS BIGINT) AS cost FROM p WHERE error_class IS NULL), r AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS k, sum(cost) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS size FROM q) SELECT event_id, cost FROM r WHERE k <= {RING_ENTRIES} AND (size <= {RING_BYTES} OR k = 1)",
        "spool_evict": f"SELECT name, size FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 20, '0') AS name, n_chars AS size, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= {SPOOL_BYTES}",
        "batch_assign": f"SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // {BATCH} AS batch FROM events",
        "rate_limit": f"{_BUCKETS} SELECT source, seq, allowed FROM b",
        "drop_counts": f"{_BUCKETS} SELECT source, count(*) AS seen, count(*) FILTER (WHERE NOT allowed) AS dropped FROM b GROUP BY source",
        **checks.oracle_sql(_P_BSD, _P_RFC, _E),
        "topic_route": f"SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN '{topics.ROOT}/' || event_type || '/device-' || CASE WHEN user_id < 1000 THEN lpad(CAST(user_id AS VARCHAR), 3, '0') ELSE CAST(user_id AS VARCHAR) END || '/logs' END AS topic FROM events",
    }
