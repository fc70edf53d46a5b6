"""Validators that SQL can't say, in plain Python for Arrow functions."""

from __future__ import annotations

import hashlib
import ipaddress

from lamina.functions.values import BASE58_ALPHABET, BECH32_ALPHABET, BECH32_GENERATOR


def ipv6(text: str) -> bool:
    """An IPv6 address that isn't :: alone and has a digit or two groups."""
    try:
        if ipaddress.IPv6Address(text).is_unspecified:
            return False
    except ValueError:
        return False
    return any(map(str.isdigit, text)) or sum(map(bool, text.split(":"))) > 1


def base58check(text: str) -> bool:
    """A 25-byte body whose last four bytes are the head of its twofold SHA-256."""
    n = 0
    for c in text:
        digit = BASE58_ALPHABET.find(c)
        if digit < 0:
            return False
        n = n * 58 + digit
    zeros = len(text) - len(text.lstrip("1"))
    raw = bytes(zeros) + n.to_bytes(-(-n.bit_length() // 8), "big")
    return len(raw) == 25 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest().startswith(raw[-4:])


def bech32(text: str) -> bool:
    """Checksum of BIP 173 or BIP 350."""
    head, one, data = text.rpartition("1")
    if not (head and one) or len(data) < 6 or set(data) - set(BECH32_ALPHABET):
        return False
    sum_ = 1
    for v in [*(ord(c) >> 5 for c in head), 0, *(ord(c) & 31 for c in head), *map(BECH32_ALPHABET.index, data)]:
        top, sum_ = sum_ >> 25, (sum_ & 0x1FFFFFF) << 5 ^ v
        for bit, g in enumerate(BECH32_GENERATOR):
            sum_ ^= g * (top >> bit & 1)
    return sum_ in (1, 0x2BC830A3)


def artefact(name: str | None) -> str | None:
    """A task or service name as given, or None for a switch, an unresolved expression or no name."""
    name = (name or "").strip()
    bad = not 0 < len(name) <= 120 or name[0] in "-/" or set(name) & set("$`({}") or not any(map(str.isalnum, name))
    return None if bad else name


def ip_category(text: str | None) -> str:
    """invalid, documentation, loopback, link-local, multicast, private, reserved or public, the first that holds."""
    try:
        a = ipaddress.ip_address((text or "").strip("[]"))
    except ValueError:
        return "invalid"
    documentation = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32")
    if any(a in ipaddress.ip_network(n) for n in documentation):
        return "documentation"
    for name in ("loopback", "link_local", "multicast", "private", "reserved"):
        if getattr(a, f"is_{name}"):
            return name.replace("_", "-")
    return "public" if a.is_global else "reserved"
