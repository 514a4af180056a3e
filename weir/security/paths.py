"""Lexical path checks."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from weir.security import Insecure

# Where sources and state may lie unless configured otherwise.
DEFAULT_PREFIXES = ("/var/log", "/var/log/journal", "/var/lib/weir", "/dev/kmsg", "/run/log/journal")


def canonical(path: str) -> str:
    """The absolute path without dot elements and double slashes; relative, empty and NUL-bearing ones are refused."""
    if not path:
        raise Insecure("empty path")
    if "\0" in path:
        raise Insecure("path with NUL byte")
    if not path.startswith("/"):
        raise Insecure(f"path {path!r} is not absolute")
    return "/" + posixpath.normpath(path).lstrip("/")


def under(path: str, prefixes: Iterable[str]) -> bool:
    """Whether the path is one of the prefixes or below one."""
    return any(path == p or path.startswith(p.rstrip("/") + "/") for p in map(canonical, prefixes))


def validate(path: str, prefixes: Iterable[str] = DEFAULT_PREFIXES) -> str:
    clean = canonical(path)
    if not under(clean, prefixes):
        raise Insecure(f"path {clean!r} is not under any allowed prefix")
    return clean
