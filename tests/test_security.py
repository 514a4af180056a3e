"""Paths, modes, pins and the configuration."""

import os

import pytest

from weir import config
from weir.security import Insecure, modes, paths, tls


@pytest.mark.parametrize("path,want", [("/var/log/x", "/var/log/x"), ("/var//log/./x", "/var/log/x"), ("/var/log/../lib", "/var/lib"), ("//a", "/a"), ("/../a", "/a"), ("/a/", "/a")])
def test_canonical(path, want):
    assert paths.canonical(path) == want


@pytest.mark.parametrize("path", ["", "relative", "./x", "../x", "/a\0b"])
def test_refused_paths(path):
    with pytest.raises(Insecure):
        paths.canonical(path)


def test_allowlist():
    assert paths.validate("/var/log/a/../b") == "/var/log/b" and paths.validate("/dev/kmsg") == "/dev/kmsg"
    for path in ("/var/logs", "/etc/passwd", "/var/log/../../etc/passwd", "/dev/kmsg2"):
        with pytest.raises(Insecure):
            paths.validate(path)
    assert paths.validate("/srv/x", ["/srv/"]) == "/srv/x"


def test_modes(tmp_path):
    f, d = tmp_path / "f", tmp_path / "d"
    f.write_text("")
    d.mkdir()
    for mode, fine in ((0o600, True), (0o640, True), (0o644, True), (0o660, False), (0o602, False)):
        os.chmod(f, mode)
        if fine:
            modes.check_config(str(f))
        else:
            with pytest.raises(Insecure):
                modes.check_config(str(f))
    for check, path, good in ((modes.check_key, f, 0o600), (modes.check_state_dir, d, 0o700)):
        for mode in (good, 0o640, 0o755):
            os.chmod(path, mode)
            if mode == good:
                check(str(path))
            else:
                with pytest.raises(Insecure):
                    check(str(path))
    for check, path in ((modes.check_key, d), (modes.check_state_dir, f), (modes.check_config, d)):
        with pytest.raises(Insecure):
            check(str(path))


def test_pins():
    der = b"certificate"
    text = tls.fingerprint(der).hex()
    spaced = " ".join(":".join(text[i : i + 2] for i in range(0, 64, 2)).upper().split())
    for pin in (text, text.upper(), spaced, f" {text}\n"):
        assert tls.matches(der, tls.parse_pin(pin))
    assert not tls.matches(b"other", tls.parse_pin(text))
    for bad in ("", "zz", text[:-2], text + "00"):
        with pytest.raises(Insecure):
            tls.parse_pin(bad)


GOOD = """
[daemon]
device_id = "dev-1"
tenant = "acme"
state_dir = "/var/lib/weir"
[parsers.p]
type = "syslog_bsd"
default_year = 2026
[sources.s]
type = "file"
parser = "p"
path = "/var/log/messages"
[transport]
mqtt_broker = "tls://b:8883"
client_cert = "/etc/c.pem"
client_key = "/etc/k.pem"
ca_cert = "/etc/ca.pem"
qos_logs = 0
[buffer]
batch_interval = "250ms"
max_entries = 0
"""


def test_config():
    c = config.parse(GOOD, skip_fs_checks=True)
    assert (c.daemon.log_level, c.buffer.max_entries, c.buffer.batch_size, c.buffer.max_bytes, c.buffer.max_line_bytes, c.spool.max_size_bytes, c.rate_limit.per_source_lines_per_sec) == ("info", 10_000, 100, 4 << 20, 64 << 10, 100 << 20, 10_000)
    assert c.transport.qos_logs == 1 and c.buffer.batch_interval.total_seconds() == 0.25 and c.shutdown.timeout.total_seconds() == 10
    assert c.parsers["p"].options == {"default_year": 2026}


@pytest.mark.parametrize("old,new,kind", [
    ('"dev-1"', '"bad id"', Insecure), ('"acme"', '""', Insecure), ('tenant = "acme"', 'tenant = "acme"\nlog_level = "loud"', config.ConfigError), ('"/var/lib/weir"', '"/etc"', Insecure),
    ('"syslog_bsd"', '"nope"', config.ConfigError), ('type = "syslog_bsd"\n', "", config.ConfigError), ('parser = "p"', 'parser = "q"', config.ConfigError), ('type = "file"', 'type = "dmesg"', config.ConfigError), ('type = "file"', 'type = "tape"', config.ConfigError), ('type = "file"\n', "", config.ConfigError),
    ('path = "/var/log/messages"\n', "", config.ConfigError), ("/var/log/messages", "/etc/shadow", Insecure), ("tls://b", "tcp://b", Insecure), ('"tls://b:8883"', '""', config.ConfigError), ('client_key = "/etc/k.pem"\n', "", Insecure), ('"/etc/ca.pem"', '"ca.pem"', Insecure),
    ("qos_logs = 0", "qos_logs = 3", config.ConfigError), ("qos_logs = 0", 'broker_cert_pin = "xy"', Insecure), ("qos_logs = 0", "unknown = 1", config.ConfigError), ('"250ms"', '"250"', config.ConfigError), ("max_entries = 0", 'max_entries = "many"', config.ConfigError), ("[daemon]", "[daemon", config.ConfigError), ("[buffer]", "[other]", config.ConfigError),
])
def test_rejections(old, new, kind):
    assert old in GOOD
    with pytest.raises(kind):
        config.parse(GOOD.replace(old, new, 1), skip_fs_checks=True)


def test_config_file_modes(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text(GOOD)
    os.chmod(path, 0o666)
    with pytest.raises(Insecure):
        config.load(str(path))
    assert config.load(str(path), skip_fs_checks=True).daemon.tenant == "acme"
