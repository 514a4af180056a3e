"""Merge, retention, limits, codecs, sources, delivery and streaming."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from weir import cli, schema
from weir.functions import jsonl, text, times
from weir.operators import parsers, ratelimit, retention
from weir.operators.filters import TimeRange, journal_priority, journal_units, split_errors, time_range
from weir.operators.merge import merge
from weir.plans import dump
from weir.sinks import files, topics
from weir.sinks.delivery import FolderPublisher, Spool, SpooledPublisher
from weir.sources import batch, tail
from weir.streaming import ingest, limiter

T0 = dt.datetime(2026, 5, 1, 12)


def records(spark, rows):
    """Canonical records from (seconds after T0 or None, message)."""
    df = spark.createDataFrame([(k, None if s is None else T0 + dt.timedelta(seconds=s), m) for k, (s, m) in enumerate(rows)], "line_ord long, ts timestamp, msg string")
    zero = {"ts_ns": F.lit(0), "ts_offset_s": F.lit(0), "severity": F.lit(6), "level": F.lit("info"), "facility": F.lit(0), "host": F.lit(""), "proc": F.lit(""), "pid": F.lit(0), "src": F.lit("s"), "fields": schema.no_fields()}
    return df.withColumns({k: v.cast(schema.RECORD[k].dataType) for k, v in zero.items()})


def test_merge(spark):
    a, b, c = records(spark, [(0, "a1"), (2, "a2"), (4, "a3")]), records(spark, [(1, "b1"), (3, "b2")]), records(spark, [(5, "c1")])
    assert [r["msg"] for r in merge([a, b, c]).collect()] == ["a1", "b1", "a2", "b2", "a3", "c1"]
    seen = Observation()
    assert [r["msg"] for r in merge([a, b, c], 2, seen).collect()] == ["a1", "b1"] and seen.get == {"written": 2}
    ties = merge([records(spark, [(1, "x"), (None, "n"), (1, "y")]), records(spark, [(1, "z"), (None, "m")])])
    assert [r["msg"] for r in ties.collect()] == ["n", "m", "x", "y", "z"]
    assert "TakeOrderedAndProject" in merge([a, b], 3)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        merge([])


def test_time_range(spark):
    df = records(spark, [(0, "a"), (1, "b"), (2, "c"), (None, "n")])
    kept = lambda r: [x["msg"] for x in r.apply(df).orderBy("line_ord").collect()]
    one = T0 + dt.timedelta(seconds=1)
    assert kept(TimeRange(one, one)) == ["b"] and kept(TimeRange(until=one)) == ["a", "b", "n"] and kept(TimeRange(since=one)) == ["b", "c"] and kept(TimeRange()) == ["a", "b", "c", "n"]
    now = dt.datetime(2026, 5, 1, 13, tzinfo=dt.UTC)
    assert time_range("1h30m", "2026-05-01T12:00:00+02:00", now) == TimeRange(now - dt.timedelta(minutes=90), dt.datetime.fromisoformat("2026-05-01T12:00:00+02:00"))
    for since, until in (("yesterday", ""), ("", "1h"), ("2026-05", "")):
        with pytest.raises(ValueError):
            time_range(since, until)


@pytest.mark.parametrize("text_,want", [("250ms", 250e-3), ("1h30m", 5400), ("-1.5s", -1.5), ("0", 0), ("2us", 2e-6), ("1.5h", 5400), (".5s", 0.5)])
def test_duration(text_, want):
    assert times.duration(text_).total_seconds() == pytest.approx(want)


@pytest.mark.parametrize("bad", ["", "5", "s", "1x", "1 s", "-", "1h-3m", "99999999999h"])
def test_bad_duration(bad):
    with pytest.raises(ValueError):
        times.duration(bad)


def simulate_ring(costs, entries, most):
    held, size = [], 0
    for k, c in enumerate(costs):
        while held and (len(held) + 1 > entries or most > 0 and size + c > most):
            size -= costs[held.pop(0)]
        held.append(k)
        size += c
    return held


def test_ring_is_its_simulation(spark):
    draw = random.Random(3)
    for entries, most in ((2, 0), (5, 100), (1, 10), (50, 60), (7, 1)):
        costs = [draw.randint(1, 40) for _ in range(30)]
        df = spark.createDataFrame(list(enumerate(costs)), "seq long, cost long")
        assert sorted(r["seq"] for r in retention.ring(df, "seq", entries, most, "cost").collect()) == simulate_ring(costs, entries, most)
    assert retention.dropped(df, retention.ring(df, "seq", 2)) == 28


def test_spool_is_its_simulation(spark, tmp_path):
    draw = random.Random(4)
    for most in (10, 45, 400):
        sizes = [draw.randint(1, 30) for _ in range(40)]
        spool = Spool(str(tmp_path / str(most)), most)
        for k, n in enumerate(sizes):
            spool.append(b"x" * n, f"{k:020}.jsonl.gz")
        df = spark.createDataFrame([(f"{k:020}.jsonl.gz", n) for k, n in enumerate(sizes)], "name string, size long")
        assert sorted(r["name"] for r in retention.spool(df, "name", "size", most).collect()) == spool.list()
        assert spool.drops == len(sizes) - len(spool.list())


def test_running_sums_over_ranges(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    up = {r["id"]: r["s"] for r in retention.running(df, "id", "v", "s").collect()}
    down = {r["id"]: r["s"] for r in retention.running(df, "id", "v", "s", descending=True).collect()}
    total = sum(k % 7 for k in range(5000))
    at = 0
    for k in range(5000):
        assert down[k] == total - at
        at += k % 7
        assert up[k] == at
    assert [r["n"] for r in retention.batches(df, "id", 7).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [7] * 714 + [2]


def test_token_bucket(spark):
    second = [0] * 20 + [1_000_000] * 15
    allowed, *_ = ratelimit.decide(10.0, 0, np.array(second), 10.0, 10.0)
    assert allowed[:20].sum() == 10 and allowed[20:].sum() == 10
    rows = [("a", T0 + dt.timedelta(microseconds=t), k) for k, t in enumerate(second)] + [("b", T0, 100 + k) for k in range(12)] + [(None, T0, 200)]
    df = spark.createDataFrame(rows, "source string, at timestamp, seq long")
    found = ratelimit.limit(df, "source", "at", "seq", 10, 10).where("allowed").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in found} == {"a": 20, "b": 10, None: 1}
    back, *_ = ratelimit.decide(1.0, 0, np.array([5_000_000, 0, 4_000_000, 6_000_000]), 1.0, 1.0)
    assert back.tolist() == [True, False, False, True]


def test_text_functions(spark):
    df = spark.createDataFrame([(bytearray(b"before\xff\xfeafter"),), (bytearray(b"ok"),), (bytearray(b"cut \xe2\x82"),)], "b binary")
    assert [r[0] for r in df.select(text.repair_utf8(F.col("b").cast("string"))).collect()] == ["before�after", "ok", "cut �"]
    kept, cut = text.cap_line(F.col("v"), 5)
    df = spark.createDataFrame([("abc\n",), ("abcd\n",), ("abcde\n",), ("abcdef",), ("éé\n",)], "v string")
    assert [(r[0], r[1]) for r in df.select(kept, cut).collect()] == [("abc\n", False), ("abcd\n", False), ("abcde", True), ("abcde", True), ("éé\n", False)]


def test_levels(spark):
    df = spark.createDataFrame([("warn",), ("warning",), ("3",), ("chartreuse",), ('"',), (None,)], "t string")
    assert [r[0] for r in df.select(schema.level_number(F.col("t"))).collect()] == [4, 4, 3, None, None, None]


def test_json_lines(spark):
    lines = ["<134>1 2026-05-01T12:00:00.120000045+02:00 h app 7 - [z k=\"<&>\"] m n", "<0>1 - - - - - - zero"]
    df = parsers.build("syslog_rfc5424").parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    out = [r[0] for r in df.select(jsonl.to_json()).collect()]
    assert out[0] == '{"ts":"2026-05-01T12:00:00.120000045+02:00","level":"info","facility":16,"host":"h","proc":"app","pid":7,"msg":"m\\u2028n","src":"syslog_rfc5424","fields":{"structured_data":"[z k=\\"<&>\\"]"}}'
    assert out[1] == '{"ts":"0001-01-01T00:00:00Z","level":"emerg","msg":"zero","src":"syslog_rfc5424"}'
    back = jsonl.from_json(spark.createDataFrame([(x,) for x in [*out, '{"ts":"0001-01-01T00:00:00Z","level":3}', '{"ts":"x","level":"info"}', '{"ts":"0001-01-01T00:00:00Z","level":"nope"}', "no json"]], "value string"))
    rows = back.collect()
    assert rows[0]["ts_ns"] == 45 and rows[0]["ts"] == dt.datetime(2026, 5, 1, 10, 0, 0, 120000) and rows[0]["msg"] == "m n" and rows[1]["ts"] is None
    assert [r["error_class"] for r in rows] == [None, None, None, "INVALID_FORMAT", "INVALID_FORMAT", "INVALID_FORMAT"] and rows[2]["severity"] == 3
    assert files.unpack(files.payload(out)) == out


def test_files_round_trip(spark, tmp_path):
    df = merge([records(spark, [(k, f"m{k}") for k in range(20)])])
    for compress in (False, True):
        path = str(tmp_path / f"o{compress}")
        assert files.write_ordered(df, path, compress) == 20 and os.stat(path).st_mode & 0o777 == 0o600
        os.rename(path, path + (".gz" if compress else ".jsonl"))
        assert [r["msg"] for r in files.read_jsonl(spark, path + (".gz" if compress else ".jsonl")).collect()] == [f"m{k}" for k in range(20)]
    files.write_jsonl(df, str(tmp_path / "many"), partition_by=["src"])
    assert files.read_jsonl(spark, str(tmp_path / "many")).count() == 20


def test_sources_and_dump(spark, tmp_path):
    bsd, rfc, journal = tmp_path / "bsd.log", tmp_path / "rfc.log", tmp_path / "journal.export"
    bsd.write_bytes(b"<13>May  1 12:00:01 h p: a\r\nbroken\n<13>May  1 12:00:03 h p: \xff\xfec")
    rfc.write_bytes(b"<13>1 2026-05-01T12:00:02Z h p - - - b\n")
    journal.write_text("MESSAGE=j1\nPRIORITY=3\n_SYSTEMD_UNIT=u1\n__REALTIME_TIMESTAMP=1777636800500000\n\nMESSAGE=j2\nPRIORITY=6\n_SYSTEMD_UNIT=u2\n__REALTIME_TIMESTAMP=1777636801500000\n\n")
    inputs = dump.sources([str(bsd)], [str(rfc), str(tmp_path / "missing.log")], journal=str(journal), journal_units=["u1"], year=2026)
    rows = dump.dump(spark, inputs).collect()
    assert [(r["msg"], r["src"]) for r in rows] == [("j1", "journal"), ("a", f"syslog_bsd:{bsd}"), ("b", f"syslog_rfc5424:{rfc}"), ("�c", f"syslog_bsd:{bsd}")]
    assert [r["msg"] for r in dump.dump(spark, inputs, TimeRange(since=T0 + dt.timedelta(seconds=1)), 2).collect()] == ["a", "b"]
    good, bad = split_errors(batch.Source(str(bsd), "syslog_bsd", "x", {"default_year": 2026}).parsed(spark))
    assert good.count() == 2 and [(r["value"], r["error_class"]) for r in bad.collect()] == [("broken", "INVALID_FORMAT")]
    parsed = batch.Source(str(journal), "journald", "j").parsed(spark)
    assert [r["msg"] for r in parsed.where(journal_priority(3) & journal_units([])).collect()] == ["j1"]
    with pytest.raises(ValueError):
        dump.dump(spark, [batch.Source(str(tmp_path / "none"), "kmsg", "k", {})])


def test_dump_goes_on_past_a_file_that_fails_while_read(spark, tmp_path):
    """A compressed file that ends in the middle gives what was read of it, and the other source all."""
    import gzip

    good, cut = tmp_path / "good.log", tmp_path / "cut.log.gz"
    good.write_bytes(b"<13>1 2026-05-01T12:00:02Z h p - - - whole\n")
    packed = gzip.compress(b"".join(b"<13>1 2026-05-01T12:00:01Z h p - - - %d\n" % (k * 7919 % 100_003) for k in range(20_000)))
    cut.write_bytes(packed[: len(packed) // 2])
    rows = dump.dump(spark, dump.sources([], [str(good), str(cut)])).collect()
    assert [r["msg"] for r in rows if r["src"].endswith("good.log")] == ["whole"] and len(rows) < 20_001
    with pytest.raises(Exception, match="(?i)eof|unexpected end|FAILED_READ_FILE"):
        batch.Source(str(cut), "syslog_rfc5424", "x").read(spark).collect()


def test_lines_of_many_files_are_ordered_by_file_and_place(spark, tmp_path):
    """Ties in time go by file name and line, however large the files are."""
    for name, n in (("b.log", 2000), ("a.log", 3), ("c.log", 50)):
        (tmp_path / name).write_text("".join(f"<13>1 2026-05-01T12:00:00Z h p - - - {name[0]}{k}\n" for k in range(n)))
    rows = dump.dump(spark, dump.sources([], [f"{tmp_path}/*.log"])).collect()
    assert [r["msg"] for r in rows] == [f"{x}{k}" for x, n in (("a", 3), ("b", 2000), ("c", 50)) for k in range(n)]


def test_commands_and_capture(tmp_path):
    assert batch.journal_arguments(("a", "b"), 3, "/d", True) == ["journalctl", "-o", "export", "--no-pager", "-f", "--directory=/d", "--unit", "a", "--unit", "b", "--priority", "3"]
    assert open(batch.capture(["echo", "hi"], str(tmp_path / "o"))).read() == "hi\n"
    for command in (["no-such-command-here"], ["sh", "-c", "echo bad >&2; exit 3"], ["sleep", "5"]):
        with pytest.raises(OSError):
            batch.capture(command, str(tmp_path / "o"), seconds=0.5)


def test_cli(spark, tmp_path, capsys):
    log = tmp_path / "l"
    log.write_text("<13>1 2026-05-01T12:00:02Z h p - - - b\n<13>1 2026-05-01T12:00:01Z h p - - - a\n")
    out = tmp_path / "out"
    assert cli.main(["dump", "--syslog-rfc5424", str(log), "-o", str(out), "--max-lines", "1"]) == cli.OK
    assert '"msg":"a"' in out.read_text() and out.read_text().count("\n") == 1
    assert cli.main(["dump", "--syslog-rfc5424", str(log), "-o", f"{tmp_path}/many/"]) == cli.OK
    assert sorted(r["msg"] for r in files.read_jsonl(spark, f"{tmp_path}/many").collect()) == ["a", "b"]
    assert cli.main(["dump"]) == cli.USAGE and cli.main(["dump", "--syslog-bsd", "x", "--since", "soon"]) == cli.USAGE
    assert cli.main(["version"]) == cli.OK


class Flaky:
    def __init__(self):
        self.down, self.sent = False, []

    def publish(self, topic, payload, qos=1, retain=False):
        if self.down:
            raise OSError("down")
        self.sent.append((topic, payload))

    def close(self):
        pass


def test_spool_and_replay(tmp_path):
    upstream, spool = Flaky(), Spool(str(tmp_path / "s"))
    out = SpooledPublisher(upstream, spool, "logs")
    upstream.down = True
    for p in (b"a", b"bb", b"ccc"):
        out.publish("logs", p)
    assert [spool.read(n) for n in spool.list()] == [b"a", b"bb", b"ccc"] and out.replay() == 0 and os.stat(spool.folder).st_mode & 0o777 == 0o700
    upstream.down = False
    assert out.replay() == 3 and not spool.list() and [p for _, p in upstream.sent] == [b"a", b"bb", b"ccc"]
    tiny = Spool(str(tmp_path / "t"), 4)
    for p in (b"aa", b"bb", b"cc"):
        tiny.append(p)
    assert [tiny.read(n) for n in tiny.list()] == [b"bb", b"cc"] and tiny.drops == 1
    tiny.append(b"too large")
    assert tiny.list() == []
    folder = FolderPublisher(str(tmp_path / "f"))
    folder.publish("a/b", b"x")
    assert len(list((tmp_path / "f/a/b").iterdir())) == 1


def test_topics():
    assert topics.topics("acme", "device-001", "root").logs == "root/acme/device-001/logs"
    for bad in (("", "d"), ("t", "")):
        with pytest.raises(ValueError):
            topics.topics(*bad)
    for good in ("tls://b:8883", "SSL://b", "mqtts://b"):
        assert topics.broker(good).startswith("tls://b")
    for bad in ("tcp://b", "mqtt://b", "http://b", "b:1", "tls://"):
        with pytest.raises(ValueError):
            topics.broker(bad)


def test_tail_offsets(tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"one\ntwo\npart")
    reader = tail.TailReader({"path": str(path), "startingoffsets": "earliest", "max_line_bytes": "4"})
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [(b"one", False), (b"two", False)] and at["position"] == 8
    with path.open("ab") as f:
        f.write(b"ial\nlast\n")
    rows, then = reader.read(at)
    assert list(rows) == [(b"part", True), (b"last", True)] and list(reader.readBetweenOffsets(at, then)) == [(b"part", True), (b"last", True)]
    with path.open("ab") as f:
        f.write(b"old\n")
    path.rename(tmp_path / "log.1")
    path.write_bytes(b"new\n")
    rows, rotated = reader.read(then)
    assert list(rows) == [(b"old", False)]
    rows, fresh = reader.read(rotated)
    assert list(rows) == [(b"new", False)] and fresh["inode"] != then["inode"]
    path.write_bytes(b"x\n")  # truncated in place
    rows, _ = reader.read(fresh)
    assert list(rows) == [(b"x", False)]
    assert tail.start_offset(str(path), None, False)["position"] == 2 and tail.start_offset(str(tmp_path / "none"), None, False)["inode"] == 0
    (tmp_path / "link").symlink_to(path)
    with pytest.raises(tail.Fatal):
        tail.start_offset(str(tmp_path / "link"), None, False)
    assert tail.start_offset(str(tmp_path / "link"), None, True, follow_symlinks=True)["position"] == 0


def test_service_outage(spark, tmp_path):
    """200 records, a publisher that is down in between: all are delivered, none twice."""
    path, upstream = tmp_path / "app.log", Flaky()
    path.write_bytes(b"")
    out = SpooledPublisher(upstream, Spool(str(tmp_path / "spool")), "logs")
    source = ingest.Followed("app", str(path), "syslog_rfc5424", from_beginning=True)
    for part in range(4):
        with path.open("a") as f:
            f.writelines(f"<13>1 2026-05-01T12:00:00Z h p - - - m{k}\n" for k in range(50 * part, 50 * part + 50))
            f.write("broken\n")
        upstream.down = part in (1, 2)
        query = ingest.start(ingest.records(spark, source), out, str(tmp_path / "checkpoint"), batch_size=20, once=True)
        query.awaitTermination(90)
    out.replay()
    lines = [x for _, p in upstream.sent for x in files.unpack(p)]
    assert sorted(lines) == sorted(set(lines)) and len(lines) == 200 and all('"src":"app"' in x for x in lines)
    assert max(len(files.unpack(p)) for _, p in upstream.sent) == 20


def test_streaming_limiter(spark, tmp_path):
    rows = [("a", T0, k) for k in range(20)] + [("b", T0, k) for k in range(5)]
    spark.createDataFrame(rows, "source string, ts timestamp, seq long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, ts timestamp, seq long").parquet(str(tmp_path / "in"))
    query = limiter.limit(stream, 10, 10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    found = {r["source"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("source").agg(F.count_if("allowed").alias("n")).collect()}
    assert found == {"a": 10, "b": 5}
