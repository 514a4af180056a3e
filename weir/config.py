"""The TOML configuration: strict keys, defaults, and checks of which the first to fail is raised."""

from __future__ import annotations

import os
import re
import stat
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from datetime import timedelta
from typing import Any, get_args, get_origin, get_type_hints

from weir.functions.times import duration
from weir.operators import parsers
from weir.security import Insecure, modes, paths, tls

ID = re.compile(r"[A-Za-z0-9_-]{1,64}")
LOG_LEVELS = ("debug", "info", "warn", "error")


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass
class Daemon:
    device_id: str = ""
    tenant: str = ""
    state_dir: str = ""
    log_level: str = "info"


@dataclass
class SourceConfig:
    type: str = ""
    parser: str = ""
    path: str = ""
    from_beginning: bool = False
    follow_rotation: bool = True
    follow_symlinks: bool = False
    units: list[str] = field(default_factory=list)
    min_priority: int = 0


@dataclass
class ParserConfig:
    type: str = ""
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Transport:
    mqtt_broker: str = ""
    client_cert: str = ""
    client_key: str = ""
    ca_cert: str = ""
    broker_cert_pin: str = ""
    qos_logs: int = 1
    qos_heartbeat: int = 0
    heartbeat_interval: timedelta = timedelta()


@dataclass
class Buffer:
    max_entries: int = 10_000
    max_bytes: int = 4 << 20
    batch_size: int = 100
    batch_interval: timedelta = timedelta(seconds=5)
    max_line_bytes: int = 64 << 10


@dataclass
class SpoolConfig:
    max_size_bytes: int = 100 << 20


@dataclass
class RateLimit:
    per_source_lines_per_sec: int = 10_000


@dataclass
class Shutdown:
    timeout: timedelta = timedelta(seconds=10)


@dataclass
class Config:
    daemon: Daemon = field(default_factory=Daemon)
    sources: dict[str, SourceConfig] = field(default_factory=dict)
    parsers: dict[str, ParserConfig] = field(default_factory=dict)
    transport: Transport = field(default_factory=Transport)
    buffer: Buffer = field(default_factory=Buffer)
    spool: SpoolConfig = field(default_factory=SpoolConfig)
    rate_limit: RateLimit = field(default_factory=RateLimit)
    shutdown: Shutdown = field(default_factory=Shutdown)
    allowed_path_prefixes: list[str] = field(default_factory=list)

    def prefixes(self) -> list[str]:
        return self.allowed_path_prefixes or list(paths.DEFAULT_PREFIXES)


#: Numbers and durations whose zero stands for the default, an explicit zero included.
_ZERO_IS_DEFAULT = {(Buffer, f.name) for f in fields(Buffer)} | {(SpoolConfig, "max_size_bytes"), (RateLimit, "per_source_lines_per_sec"), (Shutdown, "timeout"), (Transport, "qos_logs"), (Daemon, "log_level")}


def _fill(kind: type, given: Any, where: str) -> Any:
    """A dataclass from a TOML table; unknown keys and wrong types are errors."""
    if not isinstance(given, dict):
        raise ConfigError(f"config: {where} is not a table")
    if kind is ParserConfig:
        return ParserConfig(str(given.get("type", "")), {k: v for k, v in given.items() if k != "type"})
    hints = get_type_hints(kind)
    if unknown := sorted(set(given) - set(hints)):
        raise ConfigError(f"config: unknown keys: {', '.join(f'{where}.{k}'.lstrip('.') for k in unknown)}")
    out = {}
    for key, value in given.items():
        hint, name = hints[key], f"{where}.{key}".lstrip(".")
        if is_dataclass(hint):
            value = _fill(hint, value, name)
        elif get_origin(hint) is dict and is_dataclass(get_args(hint)[1]):
            if not isinstance(value, dict):
                raise ConfigError(f"config: {name} is not a table")
            value = {k: _fill(get_args(hint)[1], v, f"{name}.{k}") for k, v in value.items()}
        elif hint is timedelta:
            try:
                value = duration(value)
            except (ValueError, TypeError):
                raise ConfigError(f"config: {name}: bad duration {value!r}") from None
        elif get_origin(hint) is list:
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise ConfigError(f"config: {name} is not a list of texts")
        elif not isinstance(value, hint) or hint is int and isinstance(value, bool):
            raise ConfigError(f"config: {name} is not of type {hint.__name__}")
        if (kind, key) in _ZERO_IS_DEFAULT and not value:
            continue
        out[key] = value
    return kind(**out)


def parse(text: str | bytes, skip_fs_checks: bool = False) -> Config:
    """A checked Config from TOML."""
    try:
        table = tomllib.loads(text.decode() if isinstance(text, bytes) else text)
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as failure:
        raise ConfigError(f"config: parse: {failure}") from None
    config = _fill(Config, table, "")
    validate(config, skip_fs_checks)
    return config


def load(path: str, skip_fs_checks: bool = False) -> Config:
    """A checked Config from a file, which only its owner may be able to write."""
    if not skip_fs_checks:
        modes.check_config(path)
    with open(path, "rb") as file:
        return parse(file.read(), skip_fs_checks)


def validate(c: Config, skip_fs_checks: bool = False) -> None:
    for name, value in (("device_id", c.daemon.device_id), ("tenant", c.daemon.tenant)):
        if not ID.fullmatch(value):
            raise Insecure(f"daemon.{name} {value!r} invalid (allowed: {ID.pattern})")
    if c.daemon.log_level not in LOG_LEVELS:
        raise ConfigError(f"config: daemon.log_level {c.daemon.log_level!r} is not one of {'/'.join(LOG_LEVELS)}")
    if c.daemon.state_dir:
        paths.validate(c.daemon.state_dir, c.prefixes())
        if not skip_fs_checks:
            modes.check_state_dir(c.daemon.state_dir)
    _validate_parsers(c)
    _validate_sources(c)
    _validate_transport(c.transport, skip_fs_checks)


def _validate_parsers(c: Config) -> None:
    if not c.parsers:
        raise ConfigError("config: at least one [parsers.*] block is required")
    for name, p in c.parsers.items():
        if not p.type:
            raise ConfigError(f"config: parsers.{name}.type is required")
        if p.type not in parsers.registered_names():
            raise ConfigError(f"config: parsers.{name}.type {p.type!r} unknown (known: {parsers.registered_names()})")


def _validate_sources(c: Config) -> None:
    for name, s in c.sources.items():
        if s.parser not in c.parsers:
            raise ConfigError(f"config: sources.{name}.parser {s.parser!r} not defined in [parsers.*]")
        if s.type in ("file", "journal"):
            if not s.path:
                raise ConfigError(f"config: sources.{name}.path is required for type={s.type}")
            paths.validate(s.path, c.prefixes())
        elif s.type == "dmesg":
            raise ConfigError(f"config: sources.{name}.type=dmesg is for single exports only")
        elif s.type != "kmsg":
            raise ConfigError(f"config: sources.{name}.type {s.type!r} unknown" if s.type else f"config: sources.{name}.type is required")


def _validate_transport(t: Transport, skip_fs_checks: bool) -> None:
    if not t.mqtt_broker:
        raise ConfigError("config: transport.mqtt_broker is required")
    if not t.mqtt_broker.startswith(("tls://", "ssl://", "mqtts://")):
        raise Insecure(f"transport.mqtt_broker {t.mqtt_broker!r} must use tls://, ssl:// or mqtts://")
    if not (t.client_cert and t.client_key and t.ca_cert):
        raise Insecure("transport requires client_cert, client_key and ca_cert")
    for p in (t.client_cert, t.client_key, t.ca_cert):
        paths.canonical(p)
    if not 0 <= t.qos_logs <= 2 or not 0 <= t.qos_heartbeat <= 2:
        raise ConfigError(f"config: QoS values must be 0..2 (logs={t.qos_logs} heartbeat={t.qos_heartbeat})")
    if not skip_fs_checks:
        modes.check_key(t.client_key)
        for p in (t.client_cert, t.ca_cert):
            if not os.path.exists(p) or not stat.S_ISREG(os.stat(p).st_mode):
                raise ConfigError(f"config: {p!r} is not a regular file")
    if t.broker_cert_pin:
        tls.parse_pin(t.broker_cert_pin)
