"""Network addresses in text: hosts of addresses in the form that browsers give them, and which are external."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from urllib.parse import unquote

_SPACE = "\t\n\v\f\r    -     　﻿"
URL = re.compile(rf"(?<![0-9A-Za-z_])(?:https?|wss?)://[^{_SPACE}\"'`<>\\]+")
IPV4 = re.compile(r"(?<![0-9A-Za-z_])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_])")
IPV6 = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){2,}[0-9A-Fa-f]{0,4}")
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_NUMBER = re.compile(r"0[xX][0-9A-Fa-f]*|[0-9]+")
_DEFAULT = {"http": 80, "ws": 80, "https": 443, "wss": 443}


def _ipv4(host: str) -> str | None:
    """Dotted decimal of one to four numbers in decimal, octal or hexadecimal notation; ValueError if they do not fit."""
    parts = host.removesuffix(".").split(".")
    if not _NUMBER.fullmatch(parts[-1]):
        return None
    if len(parts) > 4:
        raise ValueError(host)
    values = []
    for p in parts:
        if not _NUMBER.fullmatch(p):
            raise ValueError(host)
        base = 16 if p[:2] in ("0x", "0X") else 8 if len(p) > 1 and p[0] == "0" else 10
        digits = p[2:] if base == 16 else p
        values.append(int(digits, base) if digits else 0)
    if any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        raise ValueError(host)
    n = values[-1] + sum(v << (8 * (3 - i)) for i, v in enumerate(values[:-1]))
    return str(ipaddress.IPv4Address(n))


def _ipv6(host: str) -> str:
    """The shortest form in hexadecimal groups: the first of the longest runs of zeros is left out."""
    words = [f"{int(w, 16):x}" for w in ipaddress.IPv6Address(host).exploded.split(":")] if "." not in host else None
    if words is None:
        n = int(ipaddress.IPv6Address(host))
        words = [f"{(n >> (112 - 16 * i)) & 0xFFFF:x}" for i in range(8)]
    best = max(re.finditer(r"(?:\b0(?: 0)+\b)", " ".join(words)), key=lambda m: (len(m.group()), -m.start()), default=None)
    if best is None:
        return ":".join(words)
    text = " ".join(words)
    return text[: best.start()].strip().replace(" ", ":") + "::" + text[best.end() :].strip().replace(" ", ":")


def url_host(url: str) -> str | None:
    """Host of an absolute address of the web schemes, without its port; None if the address is not valid."""
    scheme, found, rest = url.partition("://")
    if not found or scheme.lower() not in _DEFAULT:
        return None
    authority = re.split(r"[/?#\\]", rest.lstrip("/\\"), maxsplit=1)[0].rpartition("@")[2]
    try:
        if authority.startswith("["):
            host, _, port = authority[1:].partition("]")
            if port and not port.startswith(":"):
                return None
            port, host = port[1:], "[" + _ipv6(host) + "]"
        else:
            host, _, port = authority.partition(":")
            host = unquote(host, errors="strict")
            host = host.lower() if host.isascii() else host.replace("。", ".").encode("idna").decode("ascii").lower()
            if not host or _FORBIDDEN.search(host):
                return None
            host = _ipv4(host) or host
        if port and (not port.isascii() or not port.isdigit() or int(port) > 65535):
            return None
    except (ValueError, UnicodeError):
        return None
    return host


def kind_of(host: str) -> str | None:
    """ipv4, ipv6 or domain; None for nothing."""
    for kind, version in (("ipv4", ipaddress.IPv4Address), ("ipv6", ipaddress.IPv6Address)):
        try:
            version(host)
            return kind
        except ValueError:
            continue
    return "domain" if host else None


def external(kind: str, value: str) -> bool:
    """False for this host, and for private, shared, link-local, benchmark, multicast and reserved addresses."""
    if kind == "domain":
        return value != "localhost" and not value.endswith(".localhost")
    if kind == "ipv4":
        a, b = map(int, value.split(".")[:2])
        inner = a in (0, 10, 127) or (a == 100 and 64 <= b <= 127) or (a, b) in ((169, 254), (192, 168), (198, 18), (198, 19)) or (a == 172 and 16 <= b <= 31) or a >= 224
        return not inner
    low = value.lower()
    return low not in ("::", "::1") and not low.startswith(("fc", "fd", "fe8", "fe9", "fea", "feb", "ff"))


def endpoint(pattern: str, raw: str) -> tuple[str, str] | None:
    """Kind and value of an external address that a pattern (url, ipv4 or ipv6) has found, else None."""
    if pattern == "url":
        host = url_host(raw)
        value = host.removeprefix("[").removesuffix("]").removesuffix(".") if host else ""
    else:
        value = raw.lower()
    kind = kind_of(value)
    if kind is None or (pattern != "url" and kind != pattern) or not external(kind, value):
        return None
    return kind, value


def endpoints(text: str) -> Iterator[tuple[int, str, str]]:
    """(offset, kind, value) of every external address."""
    for pattern, expression in (("url", URL), ("ipv4", IPV4), ("ipv6", IPV6)):
        for m in expression.finditer(text):
            if found := endpoint(pattern, m.group()):
                yield m.start(), *found
