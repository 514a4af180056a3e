"""Followed sources and service mode, against fakes."""

import datetime as dt
import errno
import gzip
import json
import os
import threading
import time

import pytest

from weir import config, service
from weir.sinks import files
from weir.sinks.delivery import Spool, SpooledPublisher
from weir.sources import journal, kernel, tail
from weir.streaming import ingest
from weir.streaming.buffer import Counters, Gate, Ring


class Upstream:
    """A publisher that can be down or slow."""

    def __init__(self):
        self.down, self.delay, self.sent = False, 0.0, []

    def publish(self, topic, payload, qos=1, retain=False):
        if self.down:
            raise OSError("down")
        time.sleep(self.delay)
        self.sent.append((topic, payload, retain))

    def close(self):
        pass

    def lines(self):
        return [json.loads(x) for topic, p, retain in self.sent if not retain for x in files.unpack(p)]


def rfc(k, source="p"):
    return f"<13>1 2026-05-01T12:00:00Z h {source} - - - m{k}\n"


def once(spark, source, out, folder, **options):
    query = ingest.start(ingest.records(spark, source), out, str(folder), once=True, name=source.name, **options)
    query.awaitTermination(90)
    assert query.exception() is None


def test_two_sources_in_an_outage_lose_nothing(spark, tmp_path):
    """Two sources, each with batch 0 part 0, into one spool while the publisher is down; and again after a new start."""
    upstream = Upstream()
    out = SpooledPublisher(upstream, Spool(str(tmp_path / "spool")), "logs")
    upstream.down = True
    for name in ("one", "two"):
        (tmp_path / name).write_text("".join(rfc(k, name) for k in range(5)))
        once(spark, ingest.Followed(name, str(tmp_path / name), "syslog_rfc5424", from_beginning=True), out, tmp_path / f"c-{name}", batch_size=2)
    assert len(out.spool.list()) == 6
    # The folder of offsets is gone: batch 0 once more, of another run.
    once(spark, ingest.Followed("one", str(tmp_path / "one"), "syslog_rfc5424", from_beginning=True), out, tmp_path / "c-again", batch_size=2)
    assert len(out.spool.list()) == 9
    upstream.down = False
    assert out.replay() == 9
    assert sorted((x["src"], x["msg"]) for x in upstream.lines()) == sorted([(n, f"m{k}") for n in ("one", "one", "two") for k in range(5)])
    assert [x["msg"] for x in upstream.lines()[:5]] == [f"m{k}" for k in range(5)]


def test_a_batch_tried_again_replaces_what_it_spooled(tmp_path):
    spool = Spool(str(tmp_path / "s"))
    first = spool.append(b"a", key="one-x-000-000")
    spool.append(b"b", key="two-x-000-000")
    assert spool.append(b"c", key="one-x-000-000") == first and [spool.read(n) for n in spool.list()] == [b"c", b"b"]


JOURNAL = "".join(f"__CURSOR=c{k}\n__REALTIME_TIMESTAMP={1777636800000000 + k}\nMESSAGE=m{k}\nPRIORITY={k % 8}\n_SYSTEMD_UNIT=u{k % 2}\n_HOSTNAME=h\nSYSLOG_IDENTIFIER=s\n\n" for k in range(12))


def test_followed_journal_file_gives_what_the_batch_scan_gives(spark, tmp_path):
    path = tmp_path / "journal.export"
    path.write_text(JOURNAL)
    upstream = Upstream()
    out = SpooledPublisher(upstream, Spool(str(tmp_path / "spool")), "logs")
    once(spark, ingest.Followed("j", str(path), "journald", from_beginning=True), out, tmp_path / "c")
    with path.open("a") as f:
        f.write("MESSAGE=half")
    once(spark, ingest.Followed("j", str(path), "journald", from_beginning=True), out, tmp_path / "c")
    assert [x["msg"] for x in upstream.lines()] == [f"m{k}" for k in range(12)]
    with path.open("a") as f:
        f.write(" a record\n\n\nMESSAGE=next\n\n")
    once(spark, ingest.Followed("j", str(path), "journald", from_beginning=True), out, tmp_path / "c")
    got = upstream.lines()
    assert [x["msg"] for x in got[12:]] == ["half a record", "next"] and got[3]["level"] == "error" and got[3]["host"] == "h" and got[3]["proc"] == "s"
    from weir.sources.batch import Source

    scanned = sorted((r["msg"], r["level"], r["ts"]) for r in Source(str(path), "journald", "j").parsed(spark).where("error_class is null").select("msg", "level", "ts").collect() if r["ts"])
    assert [m for m, _, _ in scanned] == sorted(f"m{k}" for k in range(12))
    # Only the units and priorities asked for.
    some = Upstream()
    once(spark, ingest.Followed("j", str(path), "journald", from_beginning=True, units=("u1",), min_priority=4), SpooledPublisher(some, Spool(str(tmp_path / "spool2")), "logs"), tmp_path / "c2")
    assert [x["msg"] for x in some.lines()] == ["m1", "m3", "m9", "m11"]


FAKE_JOURNALCTL = """#!/usr/bin/env python3
import json, sys
given = sys.argv[1:]
json.dump(given, open({log!r}, "w"))
text = open({data!r}).read()
records = [r for r in text.split("\\n\\n") if r.strip()]
if "--after-cursor" in given:
    after = given[given.index("--after-cursor") + 1]
    at = [k for k, r in enumerate(records) if ("__CURSOR=" + after) in r.split("\\n")]
    records = records[at[0] + 1:] if at else records
if "-n" in given:
    records = records[-int(given[given.index("-n") + 1]):]
sys.stdout.write("".join(r.strip("\\n") + "\\n\\n" for r in records))
"""


def test_running_journal_is_followed_by_cursor(spark, tmp_path):
    data, log, fake = tmp_path / "data", tmp_path / "log", tmp_path / "journalctl"
    data.write_text(JOURNAL)
    fake.write_text(FAKE_JOURNALCTL.format(log=str(log), data=str(data)))
    fake.chmod(0o755)
    reader = journal.JournalReader({"command": json.dumps([str(fake)]), "units": '["a"]', "priority": "3", "directory": "/var/log/journal", "startingOffsets": "earliest"})
    start = reader.initialOffset()
    rows, end = reader.read(start)
    rows = list(rows)
    assert len(rows) == 12 and end == {"cursor": "c11"} and json.load(open(log)) == ["-o", "export", "--no-pager", "--directory=/var/log/journal", "--unit", "a", "--priority", "3"]
    assert list(reader.readBetweenOffsets(start, end)) == rows and list(reader.readBetweenOffsets(end, end)) == []
    assert journal.JournalReader({"command": json.dumps([str(fake)])}).initialOffset() == {"cursor": "c11"}
    small = journal.JournalReader({"command": json.dumps([str(fake)]), "startingOffsets": "earliest", "batch_bytes": "200"})
    part, at = small.read({"cursor": ""})
    part = list(part)
    assert 0 < len(part) < 12 and part + list(small.readBetweenOffsets(at, end)) != rows[:0]
    with pytest.raises(tail.Fatal):
        journal.JournalReader({"command": '["/no/such/journalctl"]', "startingOffsets": "earliest"}).read({"cursor": ""})
    upstream = Upstream()
    source = ingest.Followed("j", "", "journald", from_beginning=True, kind="journal", command=(str(fake),))
    out = SpooledPublisher(upstream, Spool(str(tmp_path / "spool")), "logs")
    once(spark, source, out, tmp_path / "c")
    data.write_text(JOURNAL + "__CURSOR=c12\nMESSAGE=late\n\n")
    once(spark, source, out, tmp_path / "c")
    assert [x["msg"] for x in upstream.lines()] == [f"m{k}" for k in range(12)] + ["late"]


def test_export_framing_passes_over_binary_fields(tmp_path):
    path = tmp_path / "e"
    value = b"two\nlines\n\nhere"
    path.write_bytes(b"MESSAGE=a\nBLOB\n" + len(value).to_bytes(8, "little") + value + b"\nPRIORITY=3\n\nMESSAGE=b")
    with path.open("rb") as f:
        assert list(journal.export_records(f)) == [b"MESSAGE=a\nPRIORITY=3", b"MESSAGE=b"]


def test_kernel_device_gives_one_record_a_read(tmp_path):
    """A device that blocks, that was overwritten, and whose records have further lines."""
    path = tmp_path / "kmsg"
    path.write_bytes(b"")
    answers = [b"6,1,100,-;one\n SUBSYSTEM=x\n", OSError(errno.EPIPE, "overwritten"), b"6,5,200,-;five\n", BlockingIOError()]

    def read(handle, most):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert list(kernel.device_records(str(path), read)) == [b"6,1,100,-;one\n SUBSYSTEM=x", b"6,5,200,-;five"]
    with pytest.raises(tail.Fatal):
        kernel.available(str(tmp_path / "none"))
    with pytest.raises(tail.Fatal):
        kernel.available(str(path), "darwin")


def test_kernel_messages_are_followed_by_sequence(spark, tmp_path):
    path = tmp_path / "kmsg"
    path.write_bytes(b"".join(b"6,%d,%d,-;m%d\n" % (k, 1000 * k, k) for k in range(10)))
    reader = kernel.KernelReader({"path": str(path), "startingOffsets": "earliest", "batch_records": "4"})
    start = reader.initialOffset()
    rows, at = reader.read(start)
    assert [r for r, _ in rows] == [b"6,%d,%d,-;m%d" % (k, 1000 * k, k) for k in range(4)] and at["seq"] == 3
    assert len(list(reader.readBetweenOffsets(start, at))) == 4 and kernel.KernelReader({"path": str(path)}).initialOffset()["seq"] == 9
    captured = tmp_path / "captured"  # longer than one read
    captured.write_bytes(b"".join(b"6,%d,%d,-;%s\n KEY=%d\n" % (k, k, b"w" * 300, k) for k in range(100)))
    assert list(kernel.device_records(str(captured))) == [b"6,%d,%d,-;%s\n KEY=%d" % (k, k, b"w" * 300, k) for k in range(100)]
    rows, again = reader.read({"boot": "another", "seq": 99})  # after a restart of the machine sequences begin anew
    assert again["seq"] == 3 and list(reader.readBetweenOffsets({"boot": "x", "seq": 0}, {"boot": "x", "seq": 5})) == []
    upstream = Upstream()
    out = SpooledPublisher(upstream, Spool(str(tmp_path / "spool")), "logs")
    source = ingest.Followed("k", str(path), "kmsg", {"boot_time": "2026-01-01T00:00:00Z"}, from_beginning=True, kind="kmsg")
    once(spark, source, out, tmp_path / "c")
    with path.open("ab") as f:
        f.write(b"6,10,10000,-;late\n")
    once(spark, source, out, tmp_path / "c")
    assert [x["msg"] for x in upstream.lines()] == [f"m{k}" for k in range(10)] + ["late"]


def test_endless_line_is_cut_and_passed_over(tmp_path):
    """A line far beyond a batch gives its first bytes once; memory and offsets move on."""
    path = tmp_path / "log"
    path.write_bytes(b"first\n" + b"x" * 10_000 + b"\nnext\nopen")
    reader = tail.TailReader({"path": str(path), "startingoffsets": "earliest", "max_line_bytes": "16", "batch_bytes": "1000"})
    at, found, steps = reader.initialOffset(), [], []
    begin = at
    for _ in range(30):
        rows, to = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, to)) == rows
        found += rows
        steps.append(to["position"] - at["position"])
        if to == at:
            break
        at = to
    assert found == [(b"first", False), (b"x" * 16, True), (b"next", False)] and max(steps) <= 1010 and at["position"] == path.stat().st_size - 4
    assert list(reader.readBetweenOffsets(begin, at)) == found


def test_ring_drops_the_oldest():
    ring = Ring(2)
    for x in "abcd":
        ring.push(x)
    assert (ring.drops, len(ring)) == (2, 2) and ring.pop(5) == ["c", "d"] and ring.pop(1) == []
    ring = Ring(100, 200)
    for x in range(3):
        ring.push(x, 100)
    assert ring.drops == 1 and ring.pop(9) == [1, 2]
    ring.push("large", 500)
    assert ring.pop(1) == ["large"]  # the newest stays whatever it costs
    got = []
    waiting = threading.Thread(target=lambda: got.extend(ring.pop(2, 10)))
    waiting.start()
    ring.push(1)
    ring.close()
    waiting.join(5)
    assert got == [1]
    with pytest.raises(ValueError):
        ring.push(2)


def test_offer_waits_and_then_drops_the_new_entry():
    ring = Ring(2, 100)
    assert ring.offer("a", 60) and not ring.offer("b", 60) and ring.offer("c", 30) and not ring.offer("d")
    assert (ring.refused, ring.drops) == (2, 0)
    threading.Timer(0.1, ring.pop, (1,)).start()
    assert ring.offer("e", 10, wait=10) and ring.pop(9) == ["c", "e"] and ring.offer("large", 500)
    ring.close()
    assert not ring.offer("f") and ring.refused == 3


def test_gate_is_a_token_bucket():
    gate = Gate(10, 10)
    assert sum(gate.admit(0.0) for _ in range(20)) == 10
    assert sum(gate.admit(1.0) for _ in range(20)) == 10 and not gate.admit(0.5)
    assert Gate(0, 0).rate == 10_000


def test_rate_limit_and_ring_in_service(spark, tmp_path):
    """Lines beyond the rate are dropped and counted; a slow publisher fills the ring, which drops the oldest."""
    path, upstream, counters = tmp_path / "log", Upstream(), Counters()
    path.write_text("".join(rfc(k) for k in range(50)) + "broken\n")
    out = SpooledPublisher(upstream, Spool(str(tmp_path / "spool")), "logs")
    source = ingest.Followed("s", str(path), "syslog_rfc5424", from_beginning=True)
    once(spark, source, out, tmp_path / "c", batch_size=7, gate=Gate(1, 20), counters=counters, clock=lambda: 0.0)
    assert [x["msg"] for x in upstream.lines()] == [f"m{k}" for k in range(20)]
    assert (counters.read, counters.failed, counters.limited, counters.published, counters.overflowed) == (51, 1, 30, 20, 0)
    slow, counters = Upstream(), Counters()
    slow.delay = 0.4
    once(spark, source, SpooledPublisher(slow, Spool(str(tmp_path / "spool2")), "logs"), tmp_path / "c2", batch_size=5, ring=Ring(5), counters=counters, patience=0.0)
    assert counters.overflowed > 0 and counters.published + counters.overflowed == 50 and slow.lines()[-1]["msg"] == "m49"


CONFIG = """
[daemon]
device_id = "d1"
tenant = "t1"
state_dir = "{state}"
[sources.good]
type = "file"
path = "{good}"
parser = "rfc"
from_beginning = true
[sources.many]
type = "file"
path = "{many}"
parser = "rfc"
from_beginning = true
[sources.link]
type = "file"
path = "{link}"
parser = "rfc"
from_beginning = true
[parsers.rfc]
type = "syslog_rfc5424"
[transport]
mqtt_broker = "tls://broker:8883"
client_cert = "/etc/a"
client_key = "/etc/b"
ca_cert = "/etc/c"
[buffer]
batch_interval = "200ms"
"""


def test_one_failed_source_does_not_end_the_service(spark, tmp_path):
    """A link is refused for good; the other sources, one of them a pattern, and the replay go on."""
    for name in ("good", "many-1", "many-2"):
        (tmp_path / name).write_text(rfc(0, name))
    (tmp_path / "link").symlink_to(tmp_path / "good")
    text = CONFIG.format(state=tmp_path / "state", good=tmp_path / "good", many=tmp_path / "many-*", link=tmp_path / "link")
    loaded = config.parse(f'allowed_path_prefixes = ["{tmp_path}"]\n' + text, skip_fs_checks=True)
    os.makedirs(tmp_path / "state")
    upstream = Upstream()
    running = service.Service(spark, loaded, upstream)
    assert [r.source.name for r in running.sources] == ["good", "many-0", "many-1", "link"]
    running.begin()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and (len(upstream.lines()) < 3 or not running.sources[3].fatal):
            assert running.step()
            time.sleep(0.2)
        assert sorted(x["proc"] for x in upstream.lines()) == ["good", "many-1", "many-2"]
        assert running.sources[3].fatal and not any(r.fatal for r in running.sources[:3])
        # An idle stream: what is spooled goes out by the replay alone.
        running.out.spool.append(gzip.compress(b'{"msg":"spooled"}\n'))
        until = time.monotonic() + 20
        while time.monotonic() < until and not any(x["msg"] == "spooled" for x in upstream.lines()):
            time.sleep(0.2)
        assert any(x["msg"] == "spooled" for x in upstream.lines())
        with (tmp_path / "good").open("a") as f:
            f.write(rfc(1, "good"))
        until = time.monotonic() + 30
        while time.monotonic() < until and sum(x.get("proc") == "good" for x in upstream.lines()) < 2:
            running.step()
            time.sleep(0.2)
        assert sum(x.get("proc") == "good" for x in upstream.lines()) == 2
        online = [json.loads(p) for _, p, retain in upstream.sent if retain]
        assert online == [{"online": True}]
    finally:
        running.end()


def test_failed_source_is_started_again(tmp_path):
    tries = []

    def begin():
        tries.append(dt.datetime.now())
        raise OSError("not yet")

    r = service.Running(ingest.Followed("x", "", "kmsg"), begin)
    r.step(0.0)
    r.step(0.5)
    assert len(tries) == 1 and r.due == 1.0
    r.step(1.1)
    assert len(tries) == 2 and r.due == pytest.approx(3.1) and not r.fatal


class FakeClient:
    """What the MQTT publisher asks of its library."""

    made: list = []

    def __init__(self, version, client_id="", protocol=None):
        self.client_id, self.calls, self.answers = client_id, [], True
        FakeClient.made.append(self)

    def __getattr__(self, name):
        def call(*given, **named):
            self.calls.append((name, given, named))
            if name == "connect":
                self.on_connect(self, None, None, 0, None)
            if name == "publish":
                return type("Sent", (), {"wait_for_publish": lambda _, seconds: None, "is_published": lambda _: self.answers})()
            if name == "socket":
                return type("Socket", (), {"getpeercert": lambda _, binary_form: b"certificate"})()

        return call


def test_mqtt_publisher_against_a_fake(monkeypatch):
    import hashlib
    import sys
    import types

    from weir.security import Insecure
    from weir.sinks.delivery import MQTTPublisher

    client = types.SimpleNamespace(Client=FakeClient, CallbackAPIVersion=types.SimpleNamespace(VERSION2=2), MQTTv5=5)
    mqtt = types.SimpleNamespace(client=client)
    for name, module in (("paho", types.SimpleNamespace(mqtt=mqtt)), ("paho.mqtt", mqtt), ("paho.mqtt.client", client)):
        monkeypatch.setitem(sys.modules, name, module)
    pin = hashlib.sha256(b"certificate").digest()
    out = MQTTPublisher("mqtts://broker:9000", "dev1", "context", pin, "t/status")
    made = FakeClient.made[-1]
    calls = {name: given for name, given, _ in made.calls}
    assert made.client_id == "dev1" and calls["connect"] == ("broker", 9000) and calls["tls_set_context"] == ("context",) and calls["will_set"][0] == "t/status" and "loop_start" in calls
    out.publish("t/logs", b"x", 1)
    assert made.calls[-1] == ("publish", ("t/logs", b"x"), {"qos": 1, "retain": False})
    made.answers = False
    with pytest.raises(OSError, match="no acknowledgement"):
        out.publish("t/logs", b"x", 1)
    out.close()
    assert [c[0] for c in made.calls[-2:]] == ["disconnect", "loop_stop"]
    with pytest.raises(Insecure):
        MQTTPublisher("tls://broker", "dev1", "context", b"0" * 32)
    with pytest.raises(ValueError):
        MQTTPublisher("tcp://broker", "dev1", "context")
    monkeypatch.setitem(sys.modules, "paho.mqtt", None)
    with pytest.raises(RuntimeError, match="paho-mqtt"):
        MQTTPublisher("tls://broker", "dev1", "context")
