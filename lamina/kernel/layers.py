"""Layers: every piece of script handed to another interpreter becomes a document of its own, with the layer it came from."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from dataclasses import dataclass, field

from lamina.functions.values import prefixes
from lamina.kernel import decoders
from lamina.kernel.rewrite import ONCE, Change, language, rewrite, variables

MOST_LAYERS, MOST_LEVELS, MOST_BYTES, MOST_RATIO = 2000, 12, 200_000_000, 100
DECODE, DECOMPRESS, HANDOFF = "DECODE", "DECOMPRESS", "HANDOFF"


@dataclass
class Layer:
    id: int
    parent: int | None
    depth: int
    language: str
    edge: str | None
    detail: str | None
    content: str
    final: str = ""
    rounds: int = 0
    converged: bool = False
    sha256: str = ""
    changes: list[Change] = field(default_factory=list)
    variables: dict[str, str] = field(default_factory=dict)
    #: Why which stage that this layer hands over is no layer.
    refused: list[str] = field(default_factory=list)


@dataclass
class Result:
    layers: list[Layer]
    limits: list[str]

    def path(self, layer: Layer) -> str:
        parts = []
        by = {x.id: x for x in self.layers}
        while layer is not None:
            parts.append(str(layer.id))
            layer = by.get(layer.parent)
        return "/".join(reversed(parts))


_ENCODED = re.compile(rf"(?:powershell|pwsh)(?:\.exe)?\b[^\n|;&]*?[-/–—―]{prefixes('encodedcommand')}\s+['\"]?([A-Za-z0-9+/=]{{8,}})['\"]?", re.I)
_COMMAND = re.compile(rf"(?:powershell|pwsh)(?:\.exe)?\b(?:\s+[-/](?!{prefixes('command')}\s|{prefixes('encodedcommand')}\s|file\s)\w+(?:\s+(?![-/'\"])\S+)?)*\s+[-/]{prefixes('command')}\s+(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\n&|\"']+))", re.I)
_LITERAL = r"(?:'((?:[^']|'')*)'|\"((?:[^\"`]|`.|\"\")*)\")"
_IEX = re.compile(rf"(?:^|[;&|({{\s])(?:iex|invoke-expression)\s*\(?\s*{_LITERAL}\s*\)?\s*(?=$|[;\n|}})])", re.I | re.M)
_BLOCK = re.compile(rf"(?:\[scriptblock\]::create|\$ExecutionContext\.InvokeCommand\.(?:NewScriptBlock|InvokeScript))\(\s*{_LITERAL}\s*\)", re.I)
_JS_EVAL = re.compile(r"\b(?:eval|execScript|new\s+Function|Function|setTimeout|setInterval)\(\s*('(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")")
_VB_EXECUTE = re.compile(r"\b(?:ExecuteGlobal|Execute|Eval)[ \t]*\(?[ \t]*(\"(?:[^\"\n]|\"\")*\")", re.I)
_CMD = re.compile(r"\bcmd(?:\.exe)?\s+/[ck]\s+(?:\"([^\"\n]+)\"|([^\n\"]+))", re.I)
_MSHTA = re.compile(r"\bmshta(?:\.exe)?\s+[\"']?(javascript|vbscript):([^\n\"']+|[^\n]+)", re.I)
_BLOB = re.compile(r"['\"]([A-Za-z0-9+/]{40,}={0,2})['\"]")


def _bytes_text(raw: bytes) -> str | None:
    if len(raw) % 2 == 0 and len(raw) >= 4 and raw[1::2].count(0) > 0.4 * len(raw) / 2:
        return raw.decode("utf-16-le", "replace")
    try:
        t = raw.decode("utf-8")
    except UnicodeDecodeError:
        t = raw.decode("latin-1")
    return t if sum(c.isprintable() or c in "\t\r\n" for c in t) >= 0.85 * len(t) else None


def _piped(text: str) -> list[str]:
    """Literals piped to Invoke-Expression, by its name, its alias or & (Get-Command iex)."""
    from lamina.kernel.psexpr import tokens, unescape

    if not re.search(r"\|\s*(?:iex|invoke-expression|&)", text, re.I):
        return []
    toks, out = tokens(text), []
    for i, t in enumerate(toks[:-2]):
        if t.kind in ("single", "double") and toks[i + 1].text == "|":
            names = [x.text.strip("'\"").lower() for x in toks[i + 2 : i + 6]]
            if names[0] in ("iex", "invoke-expression") or names[:2] == ["&", "("] and len(names) > 3 and names[2] in ("gcm", "get-command") and names[3] in ("iex", "invoke-expression"):
                out.append(t.text[1:-1].replace("''", "'") if t.kind == "single" else unescape(t.text[1:-1]))
    return out


def handoffs(text: str, lang: str, limits: list[str]) -> list[tuple[str, str | None, str, str]]:
    """(content, language hint, edge, detail) of each stage that a text hands over, in the order of the rules. limits: gets why a packed stage was refused."""
    from lamina.kernel.psexpr import unescape
    from lamina.kernel.rewrite import js_text, vb_text

    out = []
    for m in _ENCODED.finditer(text):
        try:
            inner = _bytes_text(base64.b64decode(m.group(1) + "=" * (-len(m.group(1)) % 4)))
        except ValueError:
            inner = None
        if inner:
            out.append((inner, "powershell", DECODE, "encoded command"))
    for m in _COMMAND.finditer(text):
        out.append((next(filter(None, m.groups())).strip(), "powershell", HANDOFF, "command"))
    if lang in ("powershell", "text", "unknown"):
        out += [(c, "powershell", HANDOFF, "piped to invoke-expression") for c in _piped(text)]
        for pattern, name in ((_IEX, "invoke-expression"), (_BLOCK, "script block")):
            for m in pattern.finditer(text):
                out.append((m.group(1).replace("''", "'") if m.group(1) is not None else unescape(m.group(2)), "powershell", HANDOFF, name))
    elif lang == "javascript":
        out += [(js_text(m.group(1)), "javascript", HANDOFF, "eval") for m in _JS_EVAL.finditer(text)]
    elif lang == "vbscript":
        out += [(vb_text(m.group(1)), "vbscript", HANDOFF, "execute") for m in _VB_EXECUTE.finditer(text)]
    for m in _CMD.finditer(text):
        out.append(((m.group(1) or m.group(2)).strip(), "batch", HANDOFF, "cmd"))
    for m in _MSHTA.finditer(text):
        out.append((m.group(2), m.group(1).lower(), HANDOFF, "mshta"))
    for m in _BLOB.finditer(text):
        try:
            raw = base64.b64decode(m.group(1) + "=" * (-len(m.group(1)) % 4))
        except ValueError:
            continue
        packed = decoders.inflate(raw, decoders.MOST_INFLATE) if raw[:2] in (b"\x1f\x8b", b"\x78\x9c", b"\x78\xda", b"\x78\x01") or "Compression" in text else None
        if packed and packed.refused:
            # Deflate has no mark of its own: what is text without unpacking was no stream.
            if packed.step != "Raw Inflate" or _bytes_text(raw) is None:
                limits.append(packed.refused)
                continue
            packed = None
        inner = _bytes_text(packed.output if packed else raw)
        # Bytes that read as a script are a stage; a value stays where it is.
        if inner and len(inner.split()) >= 3 and language(inner) != "text":
            out.append((inner, None, DECOMPRESS if packed else DECODE, packed.step.lower() if packed else "base64"))
    return [(c, h, e, d) for c, h, e, d in out if len(c.strip()) >= 3]


def analyse(text: str | None, most_levels: int = MOST_LEVELS, most_layers: int = MOST_LAYERS) -> Result:
    """All layers of one document, breadth first. Same content twice is one layer; content of an ancestor is a cycle and refused; limits are reported."""
    limits: list[str] = []
    clean = (text or "").replace("\0", "\ufffd")
    root = Layer(1, None, 0, language(clean), None, None, clean)
    layers, queue = [root], deque([root])
    known = {hashlib.sha256(clean.encode("utf-8", "surrogatepass")).hexdigest(): 1}
    root.sha256, used = next(iter(known)), 0
    by = {1: root}
    while queue:
        layer = queue.popleft()
        lang = "command" if layer.detail == "cmd" and layer.language == "batch" else layer.language
        layer.final, layer.changes, layer.rounds, layer.converged = rewrite(layer.content, lang)
        layer.variables = variables(layer.content if lang in ONCE else layer.final, lang)
        packed: list[str] = []
        handed = handoffs(layer.final, layer.language, packed)
        limits += packed
        layer.refused += packed
        for content, hint, edge, detail in handed:
            mark = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()

            def refuse(reason: str, said: str = f"{edge} {detail}, {len(content)} characters", layer: Layer = layer) -> None:
                limits.append(reason)
                layer.refused.append(f"{reason}: {said}")

            if mark in known:
                at = layer
                while at is not None and at.sha256 != mark:
                    at = by.get(at.parent)
                if at is not None:
                    refuse("cycle")
                continue
            if layer.depth + 1 > most_levels:
                refuse("max_layer_depth")
                continue
            if len(layers) >= most_layers:
                refuse("max_artifacts")
                continue
            used += len(content)
            if used > MOST_BYTES or len(content) > MOST_RATIO * max(1000, len(layer.content)):
                refuse("max_decoded_bytes_total")
                continue
            child = Layer(len(layers) + 1, layer.id, layer.depth + 1, language(content, hint), edge, detail, content, sha256=mark)
            known[mark], by[child.id] = child.id, child
            layers.append(child)
            queue.append(child)
    return Result(layers, sorted(set(limits)))
