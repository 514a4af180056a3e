"""Topic names and broker addresses."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First levels of all topics; deployments with consumers of their own pass theirs.
ROOT = "weir/v1"
KINDS = ("logs", "status", "heartbeat", "metrics")


@dataclass(frozen=True)
class Topics:
    logs: str
    status: str
    heartbeat: str
    metrics: str


def topics(tenant: str, device: str, root: str = ROOT) -> Topics:
    if not tenant or not device:
        raise ValueError("tenant and device id are required")
    return Topics(*(f"{root}/{tenant}/{device}/{kind}" for kind in KINDS))


def topic(tenant: Column, device: Column, kind: str = "logs", root: str = ROOT) -> Column:
    """The topic of rows; null where tenant or device is null or empty."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of topic {kind!r}")
    return F.when((tenant != "") & (device != ""), F.concat_ws("/", F.lit(root), tenant, device, F.lit(kind)))


def broker(address: str) -> str:
    """The address under the scheme tls; other schemes than tls, ssl and mqtts are refused."""
    parts = urlsplit(address)
    if parts.scheme.lower() not in ("tls", "ssl", "mqtts"):
        raise ValueError(f"broker {address!r} must use tls://, ssl:// or mqtts://")
    if not parts.netloc:
        raise ValueError(f"broker {address!r} has no host")
    return urlunsplit(("tls", *parts[1:]))
