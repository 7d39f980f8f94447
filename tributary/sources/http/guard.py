"""Which addresses a request may go to."""

from __future__ import annotations

import ipaddress
import socket
from urllib.parse import urlsplit

from tributary.errors import EngineError


def check_url(url: str, base_url: str, allowed_hosts: tuple[str, ...] = ()) -> None:
    """The origin of ``base_url`` and listed hosts are trusted; link-local addresses never are; other hosts must not resolve to private addresses."""
    u, b = urlsplit(url), urlsplit(base_url)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise EngineError("SOURCE_FORBIDDEN", f"{url!r} is no http address")
    try:
        found = {ipaddress.ip_address(i[4][0].split("%")[0]) for i in socket.getaddrinfo(u.hostname, u.port or (443 if u.scheme == "https" else 80), type=socket.SOCK_STREAM)}
    except OSError as e:
        raise EngineError("SOURCE_UNREACHABLE", f"{u.hostname}: {e}") from e
    plain = {a.ipv4_mapped if isinstance(a, ipaddress.IPv6Address) and a.ipv4_mapped else a for a in found}
    if any(a.is_link_local or a.is_multicast for a in plain):
        raise EngineError("SOURCE_FORBIDDEN", f"{u.hostname} is link-local")
    if (u.scheme, u.hostname, u.port) == (b.scheme, b.hostname, b.port) or u.hostname in allowed_hosts:
        return
    if any(a.is_private or a.is_loopback or a.is_reserved or a.is_unspecified for a in plain):
        raise EngineError("SOURCE_FORBIDDEN", f"{u.hostname} is a private address")
