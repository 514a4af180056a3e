"""Certificate pins and client TLS."""

from __future__ import annotations

import hashlib
import hmac
import ssl

from weir.security import Insecure
from weir.security.modes import check_key


def parse_pin(text: str) -> bytes:
    """32 bytes from hexadecimal text; colons and white space are dropped, case does not matter."""
    digits = "".join(text.split()).replace(":", "").lower()
    try:
        pin = bytes.fromhex(digits)
    except ValueError:
        raise Insecure("pin is not hexadecimal") from None
    if len(pin) != 32:
        raise Insecure(f"pin has {len(pin)} bytes, not 32")
    return pin


def fingerprint(der: bytes) -> bytes:
    return hashlib.sha256(der).digest()


def matches(der: bytes, pin: bytes) -> bool:
    return hmac.compare_digest(fingerprint(der), pin)


def client_context(certificate: str, key: str, authorities: str) -> ssl.SSLContext:
    """Mutual TLS from 1.2 on, trusting only the given authorities."""
    check_key(key)
    context = ssl.SSLContext(ssl.PROTOCOL_TLS_CLIENT)
    context.minimum_version = ssl.TLSVersion.TLSv1_2
    context.load_verify_locations(cafile=authorities)
    context.load_cert_chain(certificate, key)
    return context


def check_peer(connection: ssl.SSLSocket, pin: bytes | None) -> None:
    """After a handshake: refuses a peer whose certificate is not the pinned one."""
    if pin is not None and not matches(connection.getpeercert(binary_form=True) or b"", pin):
        raise Insecure("broker certificate does not match its pin")
