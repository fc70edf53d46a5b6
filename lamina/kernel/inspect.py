"""What is still opaque in a text, and where things stand in it: residual runs, statements, revealed strings, claimed spans."""

from __future__ import annotations

import math
import re
from bisect import bisect_right, insort
from collections import Counter

from lamina.functions import checks, values
from lamina.kernel import decoders
from lamina.kernel.psexpr import Parser, Stop, tokens

#: Hexadecimal runs of these lengths are digests.
DIGESTS = (40, 56, 64, 96, 128)
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_TRANSFORMED = re.compile(r"(['\"])((?:[^'\"`\n]|`.){4,})\1(?=\s*\.\s*(?:Insert|Remove|Replace|Substring|Trim|TrimStart|TrimEnd|PadLeft|PadRight)\s*\(|\s+-[ci]?replace\b)", re.I)


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def residual(text: str) -> list[tuple[int, int, float, str]]:
    """(offset, length, entropy, reason) of encoded runs that nothing opened: long, dense, no digest, and no recipe reads them."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        hexa = re.fullmatch("[0-9A-Fa-f]+", run) is not None
        if hexa and len(run) in DIGESTS:
            continue
        bits = entropy(run)
        if bits < (3.2 if hexa else 4.0) or decoders.search(run) is not None:
            continue
        out.append((m.start(), len(run), round(bits, 2), "hexadecimal run" if hexa else "base64-like run"))
    return out


def residual_blobs(text: str, claimed: frozenset = frozenset()) -> list[str]:
    """Base64 runs of at least 64 characters in two classes that stand outside URLs and whose plain text isn't in the text."""
    import base64

    urls = [m.span() for m in re.finditer(values.URL, text)]
    out: dict[str, None] = {}
    for m in re.finditer(values.B64_BLOB, text):
        blob = m.group()
        core = blob.rstrip("=")
        classes = sum(any(map(f, core)) for f in (str.islower, str.isupper, str.isdigit))
        k = bisect_right(urls, (m.start(), len(text) + 1)) - 1
        if blob in claimed or len(core) < 64 or len(blob) % 4 or classes < 2 or re.fullmatch("[0-9A-Fa-f]+", core) or k >= 0 and urls[k][1] > m.start():
            continue
        try:
            raw = base64.b64decode(blob, validate=True)
        except ValueError:
            continue
        plains = [t.strip() for codec in ("utf-8", "utf-16-le") if (t := raw.decode(codec, "ignore")) and sum(c.isprintable() for c in t) >= 0.85 * len(t)]
        recipe = decoders.search(blob)
        if recipe:
            plains.append(recipe.output.strip()[:64])
        if not any(p and p in text for p in plains):
            out.setdefault(blob if len(blob) <= 96 else blob[:96] + "...")
    return list(out)


def masked(text: str) -> str:
    """The text with literals blanked that a string operation consumes: ingredients, not indicators. Every place keeps its offset."""
    return _TRANSFORMED.sub(lambda m: m.group(1) + " " * len(m.group(2)) + m.group(1), text)


def statements(text: str) -> list[str]:
    """Top-level statements: cut at line ends and semicolons outside brackets and strings."""
    out, depth, start = [], 0, 0
    for t in tokens(text):
        if t.kind == "punct" and t.text in "([{":
            depth += 1
        elif t.kind == "punct" and t.text in ")]}":
            depth = max(0, depth - 1)
        elif depth == 0 and (t.kind == "line" or t.text == ";"):
            if text[start : t.start].strip():
                out.append(text[start : t.start].strip())
            start = t.end
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


def revealed(text: str, variables: dict) -> list[str]:
    """Double-quoted strings outside assignments whose variables are all known, as they read."""
    out: dict[str, None] = {}
    for s in statements(text):
        if re.match(r"\$[\w:{}]+\s*=", s):
            continue
        for t in tokens(s):
            if t.kind == "double" and "$" in t.text:
                try:
                    v = Parser([t], 0, variables).expression()
                except (Stop, RecursionError):
                    continue
                if isinstance(v, str) and v.strip():
                    out.setdefault(v)
    return list(out)


_SPANS = (("url", values.URL), ("email", values.EMAIL), ("ipv6_port", values.IPV6_PORT), ("ip_port", values.IP_PORT), ("ipv6", values.IPV6), ("ip", values.IPV4), ("domain", values.DOMAIN))


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of indicators that don't overlap: the more specific type claims its place first."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _SPANS:
        for m in re.finditer(pattern, text):
            if kind == "domain" and m.group().rsplit(".", 1)[-1].lower() not in values.TLDS or kind == "ipv6" and not checks.ipv6(m.group()) or kind == "ipv6_port" and not checks.ipv6(m.group(1)):
                continue
            k = bisect_right(taken, (m.start(), len(text) + 1, ""))
            if k and taken[k - 1][1] > m.start() or k < len(taken) and taken[k][0] < m.end():
                continue
            insort(taken, (m.start(), m.end(), "ip" if kind == "ipv6" else kind))
    return taken


def defang(value: str, kind: str) -> str:
    if kind in ("ip", "ipv6_port") and value.count(":") >= 2:
        return value.replace(":", "[:]").replace(".", "[.]")
    return re.sub(r"(?i)^http(s?)(?=://)", r"hxxp\1", value).replace(".", "[.]").replace("@", "[@]")


def defanged(text: str) -> str:
    """Free text with its indicators defanged and everything else as it is."""
    out, at = [], 0
    for a, b, kind in spans(text):
        out += [text[at:a], defang(text[a:b], kind)]
        at = b
    return "".join(out) + text[at:]
