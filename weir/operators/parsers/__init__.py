"""Parsers of log lines into the canonical record, and their registry."""

from weir.operators.parsers import bsd, dmesg, journald, kmsg, rfc5424  # noqa: F401  (they register themselves)
from weir.operators.parsers.registry import LineParser, build, register, registered_names  # noqa: F401
