"""Owner and mode checks of files and folders."""

from __future__ import annotations

import os
import stat

from weir.security import Insecure


def _owned(path: str, kind: str) -> os.stat_result:
    found = os.lstat(path)
    if kind == "dir" and not stat.S_ISDIR(found.st_mode):
        raise Insecure(f"{path} is not a directory")
    if kind == "file" and not stat.S_ISREG(found.st_mode):
        raise Insecure(f"{path} is not a regular file")
    return found


def check_config(path: str) -> None:
    """A regular file that only its owner may write."""
    mode = stat.S_IMODE(_owned(path, "file").st_mode)
    if mode & 0o022:
        raise Insecure(f"{path} is group/world-writable ({mode:04o})")


def _mine(found: os.stat_result, path: str) -> None:
    if found.st_uid != os.geteuid():
        raise Insecure(f"{path} belongs to user {found.st_uid}, not {os.geteuid()}")


def check_key(path: str) -> None:
    """A regular file of the current user, of mode 0600."""
    found = _owned(path, "file")
    if stat.S_IMODE(found.st_mode) != 0o600:
        raise Insecure(f"{path} has mode {stat.S_IMODE(found.st_mode):04o}, not 0600")
    _mine(found, path)


def check_state_dir(path: str) -> None:
    """A folder of the current user, of mode 0700."""
    found = _owned(path, "dir")
    if stat.S_IMODE(found.st_mode) != 0o700:
        raise Insecure(f"{path} has mode {stat.S_IMODE(found.st_mode):04o}, not 0700")
    _mine(found, path)
