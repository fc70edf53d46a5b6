"""Static rewriting of one layer of script: constant parts become literals, again and again until nothing changes.

Each rule takes a text and gives a text; the order of a language's rules is
data (RULES). A round's result that breaks brackets or quotes more than its
input is not taken. Nothing is executed; what can't be computed stays.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import islice
from typing import NamedTuple
from urllib.parse import unquote

from lamina.functions.values import ALIASES, STOCK
from lamina.kernel import batch, decoders
from lamina.kernel.psexpr import MOST_DEPTH, Parser, Stop, quote, shown, tokens

MOST_ROUNDS = 20


class Change(NamedTuple):
    round: int
    rule: str
    before: str
    after: str


# -- PowerShell


def ps_backticks(text: str) -> str:
    """Backticks inside words, outside strings and comments."""
    return re.sub(r"(?P<keep><#.*?#>|#[^\n]*|'(?:[^']|'')*'|\"(?:[^\"`]|`.|\"\")*\")|(?<=[\w-])`(?=[A-Za-z0-9-])", lambda m: m.group() if m.group("keep") else "", text, flags=re.S)


_PLAIN = {**dict.fromkeys(map(ord, "‘’‚‛"), "'"), **dict.fromkeys(map(ord, "“”„"), '"'), **dict.fromkeys(map(ord, "–—―"), "-")}
_PS_KEPT = r"<#.*?#>|#[^\n]*|'(?:[^']|'')*'|\"(?:[^\"`]|`.|\"\")*\""


def ps_quotes(text: str) -> str:
    """Typographic quotes and dashes that PowerShell reads as plain ones, outside strings and comments."""
    if not any(ord(c) > 127 for c in text):
        return text
    return re.sub(rf"(?P<keep>{_PS_KEPT})|[‘’‚‛“”„–—―]", lambda m: m.group() if m.group("keep") else m.group().translate(_PLAIN), text, flags=re.S)


def ps_calls(text: str) -> str:
    """& 'name' becomes name, where it is a plain command word; a dot before a name loads it and stays."""
    return re.sub(r"&\s*(?:'([A-Za-z][\w-]*)'|\"([A-Za-z][\w-]*)\")(?=[\s;|)}]|$)", lambda m: m.group(1) or m.group(2), text)


_SHORT = re.compile(r"(?im)(?:^|[;|{(&])[ \t]*(?:" + "|".join(sorted((re.escape(a) for a in ALIASES if a not in "%?"), key=len, reverse=True)) + r")\b(?![ \t]*[=.\[(:-])|\b(?:Set-Alias|New-Alias|sal|nal)\b")


def ps_aliases(text: str) -> str:
    """Built-in aliases, and those the script itself sets, at the place of a command."""
    if not _SHORT.search(text):
        return text
    toks = tokens(text)
    own = {m.group(1).lower(): m.group(2) for m in re.finditer(r"\b(?:Set-Alias|New-Alias|sal|nal)\s+(?:-Name\s+)?['\"]?([\w-]+)['\"]?\s+(?:-Value\s+)?['\"]?([\w-]+)['\"]?", text, re.I)}
    defined = {m.group(1).lower() for m in re.finditer(r"\bfunction\s+([\w-]+)", text, re.I)}
    out, at = [], 0
    for i, t in enumerate(toks):
        before = toks[i - 1] if i else None
        after = toks[i + 1] if i + 1 < len(toks) else None
        if t.kind != "name" or t.text.lower() in defined or not (before is None or before.kind == "line" or before.text in (";", "|", "{", "(", "&")) or before is not None and before.text == "{" and i > 1 and toks[i - 2].text == "@":
            continue
        # A name before =, (, :: or a member is no command.
        if after is not None and (after.text in ("=", ".", "[") or after.kind == "colons" or after.text == "(" and after.start == t.end):
            continue
        command = own.get(t.text.lower()) or ALIASES.get(t.text.lower())
        if command and command.lower() != t.text.lower() and t.text.lower() not in ("foreach", "where", "set", "echo"):
            out += [text[at : t.start], command]
            at = t.end
    return "".join(out) + text[at:]


def ps_stock(text: str) -> str:
    """$ShellId, $PSHOME and a few variables of the environment, where they are indexed or joined; values are assumed."""

    def put(m: re.Match) -> str:
        value = STOCK.get(m.group(1).strip("{}").lower())
        return m.group() if value is None else quote(value)

    return re.sub(r"\$(\{?(?:ShellId|PSHOME|env:\w+)\}?)(?=\s*\[\s*-?\d|\.Substring|\.Replace)", put, text, flags=re.I)


def ps_casts(text: str) -> str:
    """[string] before a literal says nothing."""
    return re.sub(r"\[string\]\s*(?='|\")", "", text, flags=re.I)


def ps_loops(text: str) -> str:
    """A byte array that a loop decodes with a constant key, and the text it gives: for ($i...) { $a[$i] = $a[$i] -bxor k }."""
    if not re.search(r"\bfor\s*\(", text, re.I):
        return text
    known = assigned(text)

    def loop(m: re.Match) -> str:
        data, op, key = known.get(m.group("a")), m.group("op").lower(), m.group("k")
        k = known.get(key.strip("$")) if key.startswith("$") else int(key, 0)
        if not isinstance(data, (list, bytes)) or not isinstance(k, int) or not all(isinstance(x, int) for x in data):
            return m.group()
        step = {"-bxor": lambda x: x ^ k, "-band": lambda x: x & k, "-bor": lambda x: x | k, "+": lambda x: x + k, "-": lambda x: x - k}[op]
        out = bytes(step(x) & 255 for x in data).decode("latin-1")
        return f"${m.group('a')} = {quote(out)}" if readable(out) else m.group()

    return re.sub(r"for\s*\(\s*\$(?P<i>\w+)\s*=\s*0\s*;[^;{}]*;[^{}]*\)\s*\{\s*\$(?P<a>\w+)\[\$(?P=i)\]\s*=\s*(?:\[\w+\])?\s*\(?\s*\$(?P=a)\[\$(?P=i)\]\s*(?P<op>-bxor|-band|-bor|[+-])\s*(?P<k>\$?\w+)\s*\)?\s*;?\s*\}", loop, text, flags=re.I)


@lru_cache(maxsize=16)
def assigned(text: str) -> dict:
    """Variables with one known value: assigned once, at top level, from a constant expression."""
    toks = tokens(text)
    known: dict = {}
    count: dict[str, int] = {}
    depth = 0
    for i, t in enumerate(toks):
        if t.text in "{}" and t.kind == "punct":
            depth += 1 if t.text == "{" else -1
        nxt = toks[i + 1].text if i + 1 < len(toks) else ""
        after = toks[i + 2].text if i + 2 < len(toks) else ""
        if t.kind == "var" and (nxt == "=" or nxt in "+-*/" and nxt and after == "="):
            name = t.text.strip("${}")
            count[name] = count.get(name, 0) + 1
            if nxt == "=" and after != "=" and depth == 0 and (i == 0 or toks[i - 1].kind == "line" or toks[i - 1].text == ";"):
                p = Parser(toks, i + 2, known)
                try:
                    value = p.expression()
                except (Stop, RecursionError):
                    known.pop(name, None)
                    continue
                if p.at == len(toks) or toks[p.at].kind == "line" or toks[p.at].text == ";":
                    known[name] = value
            else:
                known.pop(name, None)
    # A parameter or loop variable of that name is another variable inside its block.
    local = {n for m in re.finditer(r"\bparam\s*\(([^)]*)\)|\bforeach\s*\(\s*(\$\w+)\s+in|\bfunction\s+[\w-]+\s*\(([^)]*)\)", text, re.I) for n in re.findall(r"\$(\w+)", " ".join(filter(None, m.groups())))}
    return {k: v for k, v in known.items() if count[k] == 1 and k not in local}


_STARTS = frozenset(("single", "double", "var"))
_FOLLOWS = frozenset("+*,[.|")


def ps_fold(text: str) -> str:
    """Maximal constant expressions that are text become literals."""
    toks = tokens(text)
    out, at, i = [], 0, 0
    known = assigned(text)
    last = len(toks) - 1
    while i <= last:
        t = toks[i]
        before = toks[i - 1] if i else None
        kind = t[0]
        if not (kind in _STARTS or t[1] in ("[", "(") or kind == "op" and t[1].lower() == "-join"):
            i += 1
            continue
        nxt = toks[i + 1] if i < last else None
        # A literal or variable by itself is no expression to fold; something has to follow.
        starts = nxt is not None and (kind not in _STARTS or nxt[0] == "op" or nxt[1] in _FOLLOWS) and not (kind == "var" and nxt[1] == "=")
        bound = before is not None and before.kind not in ("line",) and (before.text in (".", "%", "*", "/") or before.kind in ("colons", "dots") or before.kind == "op" and before.text.lower() in ("-f", "-replace", "-split", "-creplace", "-ireplace", "-like", "-match") or before.kind in ("single", "double", "var") and t.text in ("[", "(") or before.text in (")", "]") and t.text in ("[", "(") or before.kind == "name" and t.text in ("(", "[") and before.end == t.start)
        if starts and not bound and not (t[1] == "(" and i + MOST_DEPTH <= last and all(x[1] == "(" for x in toks[i : i + MOST_DEPTH])):  # too deep to be read
            p = Parser(toks, i, known)
            try:
                value = p.expression()
            except (Stop, RecursionError):
                value = None
            if isinstance(value, str) and p.at - i > 1 and "\0" not in value:
                end = toks[p.at - 1].end
                literal = quote(value, double=p.doubles > 0 and not p.singles)
                if literal != text[t.start : end]:
                    out += [text[at : t.start], literal]
                    at = end
                i = p.at
                continue
        i += 1
    return "".join(out) + text[at:]


# -- JavaScript and VBScript: literal patterns around which constants fold

_JS_STRING = r"(?:'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")"
_JS_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|([0-7]{1,3})|(.))", re.S)


def js_text(literal: str) -> str:
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}
    return _JS_ESCAPE.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)) if m.group(1) or m.group(2) else chr(int(m.group(3), 8)) if m.group(3) else plain.get(m.group(4), m.group(4)), literal[1:-1])


def js_quote(text: str, like: str = "'") -> str:
    body = text.replace("\\", "\\\\").replace(like, "\\" + like).replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return like + body + like


def readable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.85 * len(text)


def _sum(expression: str) -> int | None:
    """A code given as a sum, difference or product of numbers."""
    try:
        p = Parser([t for t in tokens(expression) if t.kind != "line"])
        value = p.expression()
        return int(value) if p.at == len(p.toks) and isinstance(value, (int, float)) and not isinstance(value, bool) and value == int(value) else None
    except (Stop, RecursionError, OverflowError):
        return None


def js_codes(text: str) -> str:
    def put(m: re.Match) -> str:
        codes = [_sum(x) for x in m.group(1).split(",")]
        if any(c is None or not 0 <= c < 0x110000 for c in codes):
            return m.group()
        return js_quote("".join(map(chr, codes)))

    return re.sub(r"\bString\.fromCharCode\(([\d\s,+*()xXa-fA-F-]+)\)", put, text)


def js_decoders(text: str) -> str:
    def put(m: re.Match) -> str:
        inner = js_text(m.group(2))
        try:
            out = base64.b64decode(inner + "=" * (-len(inner) % 4), validate=True).decode("latin-1") if m.group(1) == "atob" else unquote(re.sub(r"%u([0-9A-Fa-f]{4})", lambda k: chr(int(k.group(1), 16)), inner))
        except ValueError:
            return m.group()
        return js_quote(out, m.group(2)[0]) if readable(out) else m.group()

    text = re.sub(rf"\b(unescape|decodeURIComponent|decodeURI|atob)\(\s*({_JS_STRING})\s*\)", put, text)

    def plain(m: re.Match) -> str:
        out = js_text(m.group())
        return js_quote(out, m.group()[0]) if readable(out) and "\\" in m.group() else m.group()

    return re.sub(_JS_STRING, lambda m: plain(m) if re.search(r"\\(?:x|u)[0-9A-Fa-f]", m.group()) else m.group(), text)


def js_concat(text: str) -> str:
    one = re.compile(rf"({_JS_STRING})(?:\s*\+\s*{_JS_STRING})+")
    return one.sub(lambda m: js_quote("".join(js_text(x) for x in re.findall(_JS_STRING, m.group())), m.group()[0]), text)


def js_methods(text: str) -> str:
    s = _JS_STRING
    text = re.sub(rf"({s})\.split\(\s*(?:''|\"\")\s*\)\.reverse\(\)\.join\(\s*(?:''|\"\")\s*\)", lambda m: js_quote(js_text(m.group(1))[::-1], m.group(1)[0]), text)
    text = re.sub(rf"({s})\.split\(\s*({s})\s*\)\.join\(\s*({s})\s*\)", lambda m: js_quote(js_text(m.group(3)).join(js_text(m.group(1)).split(js_text(m.group(2))) if js_text(m.group(2)) else list(js_text(m.group(1)))), m.group(1)[0]), text)
    text = re.sub(rf"({s})\.replace\(\s*({s})\s*,\s*({s})\s*\)", lambda m: js_quote(js_text(m.group(1)).replace(js_text(m.group(2)), js_text(m.group(3)), 1), m.group(1)[0]), text)

    def cut(m: re.Match) -> str:
        v, name, a, b = js_text(m.group(1)), m.group(2), int(m.group(3)), int(m.group(4)) if m.group(4) else None
        if name == "substring":
            a, b = max(0, a), len(v) if b is None else max(0, b)
            out = v[min(a, b) : max(a, b)]
        elif name == "substr":
            a = max(0, len(v) + a) if a < 0 else a
            out = v[a : None if b is None else a + b]
        elif name == "slice":
            out = v[a:b]
        else:
            out = v[a : a + 1] if a >= 0 else ""
        return js_quote(out, m.group(1)[0])

    text = re.sub(rf"({s})\.(substring|substr|slice|charAt)\(\s*(-?\d+)\s*(?:,\s*(-?\d+)\s*)?\)", cut, text)
    text = re.sub(rf"({s})\.(toUpperCase|toLowerCase|trim)\(\)", lambda m: js_quote({"toUpperCase": str.upper, "toLowerCase": str.lower, "trim": str.strip}[m.group(2)](js_text(m.group(1))), m.group(1)[0]), text)
    return re.sub(rf"({s})\[(\d+)\]", lambda m: js_quote(js_text(m.group(1))[int(m.group(2))], m.group(1)[0]) if int(m.group(2)) < len(js_text(m.group(1))) else m.group(), text)


def js_members(text: str) -> str:
    """obj['name'] becomes obj.name where the name is a plain one that holds no digit."""
    return re.sub(r"(?<=[\w)\]])\[\s*(?:'([A-Za-z_$][A-Za-z_$]*)'|\"([A-Za-z_$][A-Za-z_$]*)\")\s*\](?!\s*=[^=])", lambda m: "." + (m.group(1) or m.group(2)), text)


_VB_STRING = r"\"(?:[^\"\n]|\"\")*\""


def vb_text(literal: str) -> str:
    return literal[1:-1].replace('""', '"')


def vb_quote(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def vb_codes(text: str) -> str:
    def put(m: re.Match) -> str:
        n = _sum(re.sub(r"&[Hh]([0-9A-Fa-f]+)&?", r"0x\1", m.group(1)))
        return vb_quote(chr(n)) if n is not None and (32 <= n < 0xD800) else m.group()

    return re.sub(r"\bChrW?\$?\(([\d\s+*&HhA-Fa-f()-]+?)\)(?!\))", put, text, flags=re.I)


def vb_concat(text: str) -> str:
    return re.sub(rf"({_VB_STRING})(?:[ \t]*[&+][ \t]*{_VB_STRING})+", lambda m: vb_quote("".join(map(vb_text, re.findall(_VB_STRING, m.group())))), text)


def vb_calls(text: str) -> str:
    s = _VB_STRING
    one = {"strreverse": lambda v: v[::-1], "ucase": str.upper, "lcase": str.lower, "trim": lambda v: v.strip(" "), "ltrim": lambda v: v.lstrip(" "), "rtrim": lambda v: v.rstrip(" ")}
    text = re.sub(rf"\b(StrReverse|UCase|LCase|Trim|LTrim|RTrim)\(\s*({s})\s*\)", lambda m: vb_quote(one[m.group(1).lower()](vb_text(m.group(2)))), text, flags=re.I)
    text = re.sub(rf"\bReplace\(\s*({s})\s*,\s*({s})\s*,\s*({s})\s*\)", lambda m: vb_quote(vb_text(m.group(1)).replace(vb_text(m.group(2)), vb_text(m.group(3)))) if len(m.group(2)) > 2 else m.group(), text, flags=re.I)
    text = re.sub(rf"\bMid\(\s*({s})\s*,\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", lambda m: vb_quote(vb_text(m.group(1))[int(m.group(2)) - 1 :][: int(m.group(3)) if m.group(3) else None]) if int(m.group(2)) else m.group(), text, flags=re.I)
    text = re.sub(rf"\b(Left|Right)\(\s*({s})\s*,\s*(\d+)\s*\)", lambda m: vb_quote(vb_text(m.group(2))[: int(m.group(3))] if m.group(1).lower() == "left" else vb_text(m.group(2))[len(vb_text(m.group(2))) - min(int(m.group(3)), len(vb_text(m.group(2)))) :]), text, flags=re.I)
    return re.sub(rf"\bJoin\(\s*Split\(\s*({s})\s*,\s*({s})\s*\)\s*,\s*({s})\s*\)", lambda m: vb_quote(vb_text(m.group(3)).join(vb_text(m.group(1)).split(vb_text(m.group(2))))) if len(m.group(2)) > 2 else m.group(), text, flags=re.I)


def vb_lines(text: str) -> str:
    return re.sub(r"[ \t]+_[ \t]*\n[ \t]*", " ", text)


_VB_CONSTANTS = {"vbcrlf": "\r\n", "vbnewline": "\r\n", "vbcr": "\r", "vblf": "\n", "vbtab": "\t", "vbnullchar": "\0", "vbnullstring": ""}


def vb_constants(text: str) -> str:
    """Named characters beside a literal. Line ends can't stand in a literal, so they become the call that gives them."""

    def put(m: re.Match) -> str:
        value = _VB_CONSTANTS[m.group("name").lower()]
        if value.isprintable() or value == "\t":
            return vb_quote(vb_text(m.group("text")) + value)
        return m.group("text") + " & " + " & ".join(f"Chr({ord(c)})" for c in value)

    return re.sub(rf"(?P<text>{_VB_STRING})[ \t]*[&+][ \t]*(?P<name>vbCrLf|vbNewLine|vbCr|vbLf|vbTab|vbNullString)\b", put, text, flags=re.I)


def _propagate(text: str, declare: re.Pattern, folded: bool, literal: str) -> str:
    """Variables assigned once, by a whole line, from a literal: their later uses beside an operator become the literal."""
    found: dict[str, list] = {}
    for m in declare.finditer(text):
        found.setdefault(m.group(1).lower() if folded else m.group(1), []).append(m)
    flags = re.I if folded else 0
    for name, ms in found.items():
        if len(ms) != 1:
            continue
        m = ms[0]
        if len(re.findall(rf"(?<![\w.$]){re.escape(name)}\s*(?:=(?!=)|\+=)", text, flags)) != 1:
            continue
        op = r"&" if literal is _VB_STRING else r"\+"
        head, tail = text[: m.end()], text[m.end() :]
        tail = re.sub(rf"(?<![\w.$'\"])(?P<n>{re.escape(name)})(?=\s*{op}\s*(?:{literal}|\w))|(?P<p>{op}\s*)(?P<k>{re.escape(name)})(?![\w(\[.'\"])", lambda k: m.group(2) if k.group("n") else k.group("p") + m.group(2), tail, flags=flags)
        text = head + tail
    return text


_JS_DECLARE = re.compile(rf"^[ \t]*(?:var|let|const)?[ \t]*([A-Za-z_$][\w$]*)[ \t]*=[ \t]*({_JS_STRING})[ \t]*;?[ \t]*$", re.M)
_VB_DECLARE = re.compile(rf"^[ \t]*(?:Const[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*({_VB_STRING})[ \t]*$", re.M | re.I)


def js_variables(text: str) -> str:
    return _propagate(text, _JS_DECLARE, False, _JS_STRING)


def vb_variables(text: str) -> str:
    return _propagate(text, _VB_DECLARE, True, _VB_STRING)


_ENCODED_LITERAL = re.compile(r"'([A-Za-z0-9+/=_-]{24,}|(?:[^'\n%]*%[0-9A-Fa-f]{2}){3,}[^'\n]*)'")


def ps_search(text: str) -> str:
    """Encoded literals that a recipe reads, in plain text. What reads as a script is left for a layer of its own, a digest is a value itself."""

    def put(m: re.Match) -> str:
        run = m.group(1)
        if re.fullmatch("[0-9A-Fa-f]+", run) and len(run) in (32, 40, 56, 64, 96, 128) or sum(any(map(f, run)) for f in (str.islower, str.isupper, str.isdigit)) < 2:
            return m.group()
        found = decoders.search(run)
        plain = found is not None and "\n" not in found.output and found.output.isprintable() and language(found.output) == "text"
        return quote(found.output) if plain else m.group()

    return _ENCODED_LITERAL.sub(put, text)


#: Rules that are tried only where a round of all others changed nothing.
LAST: dict[str, list[tuple[str, Callable[[str], str]]]] = {"powershell": [("search", ps_search)]}
LAST["text"] = LAST["unknown"] = LAST["powershell"]

#: The rules of each language, in order; what is no script of a known kind is read like PowerShell.
RULES: dict[str, list[tuple[str, Callable[[str], str]]]] = {
    "powershell": [("quotes", ps_quotes), ("backticks", ps_backticks), ("calls", ps_calls), ("aliases", ps_aliases), ("stock", ps_stock), ("casts", ps_casts), ("loops", ps_loops), ("fold", ps_fold)],
    "javascript": [("codes", js_codes), ("decoders", js_decoders), ("methods", js_methods), ("concat", js_concat), ("members", js_members), ("variables", js_variables)],
    "vbscript": [("lines", vb_lines), ("codes", vb_codes), ("constants", vb_constants), ("calls", vb_calls), ("concat", vb_concat), ("variables", vb_variables)],
    "batch": [("parse", batch.resolve)],
    "command": [("parse", batch.resolve_command)],
}
#: Languages read once: what their phases leave is no input of the same phases.
ONCE = ("batch", "command")
RULES["text"] = RULES["unknown"] = RULES["powershell"]

# -- the language of a text

# Marks of each language as (pattern, weight, hits that count at most).
MARKS = {
    "powershell": [(r"(?im)\$[a-z_]\w*\s*=(?!=)", 1.5, 4), (r"(?i)\$\{?env:", 3, 2), (r"(?i)\b(?:Write-(?:Host|Output)|Invoke-(?:Expression|WebRequest|RestMethod)|New-Object|Start-Process|ForEach-Object|Where-Object|Get-Content|Set-Content|Add-Type)\b", 3, 3), (r"(?i)\[(?:System\.)?(?:Convert|Text\.Encoding|char|string|scriptblock|byte\[\]|IO\.\w+|Net\.\w+|Array)\]", 3, 3), (r"(?i)-(?:join|split|replace|bxor|f|eq|ne|match|like)\b", 1, 4), (r"(?im)(?:^|[;|&(]\s*)(?:iex|iwr|irm|sal|nal|gci)\b", 2, 2), (r"\|\s*[%?]\s*\{", 2, 2), (r"(?i)\bparam\s*\(", 2, 1), (r"(?i)\$_\b|\$true\b|\$false\b|\$null\b", 1, 3)],
    "batch": [(r"(?im)^\s*@?echo\s+off\b", 5, 1), (r"(?im)^\s*set\s+(?:/[ap]\s+)?\"?[\w#$.-]+=", 2, 4), (r"(?i)%[a-z_][\w#$.-]*(?::~-?\d+(?:,-?\d+)?|:[^%=\n]*=[^%\n]*)?%", 1.5, 4), (r"(?i)\bsetlocal\b|\bendlocal\b", 3, 1), (r"(?im)^\s*(?:rem\b|::)", 2, 1), (r"(?im)\bgoto\s+:?\w+|\bcall\s+:\w+|^\s*:\w+\s*$|%~[a-z]*\d", 2, 2), (r"\w\^\w|\^[&|<>]", 1, 2), (r"(?i)\bfor\s+/[fdlr]\b", 3, 1)],
    "javascript": [(r"\b(?:var|let|const)\s+[A-Za-z_$][\w$]*\s*=", 2, 3), (r"\bfunction\b\s*[\w$]*\s*\(", 2, 2), (r"=>", 1, 2), (r"\bconsole\.\w+\s*\(", 3, 1), (r"(?i)\bWScript\.Echo\s*\(", 1, 1), (r"(?i)\bnew\s+(?:ActiveXObject|Function)\s*\(", 3, 1), (r"\bString\.fromCharCode\b|\batob\s*\(|\bunescape\s*\(", 3, 1), (r"\b(?:setTimeout|setInterval)\s*\(", 2, 1), (r"\b(?:document|window)\.\w+", 2, 1), (r"(?m);\s*$", 0.5, 4)],
    "vbscript": [(r"(?im)^\s*Dim\s+\w+", 3, 1), (r"(?im)^\s*Set\s+\w+\s*=\s*(?:CreateObject|GetObject|New)\b", 3, 1), (r"(?m)^\s*(?:(?:Public|Private)\s+)?(?:Const|CONST)\s+\w+\s*=", 3, 1), (r"(?i)\bWScript\.Echo\s+[^(\s]", 2, 1), (r"(?i)\bCreateObject\s*\(", 2, 1), (r"(?i)\bChrW?\$?\s*\(", 1.5, 2), (r"(?i)\bEnd\s+(?:Sub|Function|If)\b", 3, 1), (r"(?i)\bExecute(?:Global)?\b|\bStrReverse\s*\(|\bvbCrLf\b|\bMsgBox\b", 2, 2), (r"(?i)\"\s*&\s*(?:\"|\w)", 1, 3), (r"(?m)^\s*'", 0.5, 2)],
    "hta": [(r"(?i)<\s*hta:application\b", 10, 1)],
    "wsf": [(r"(?i)<\s*job\b[^>]*>", 6, 1), (r"(?i)<\s*package\s*>", 4, 1)],
}
_MARKS = {n: [(re.compile(p), w, most) for p, w, most in marks] for n, marks in MARKS.items()}
TIES = ("hta", "wsf", "powershell", "batch", "javascript", "vbscript")
LEAST_SCORE = 3.0


def _points(view: str, name: str) -> float:
    return sum(weight * sum(1 for _ in islice(pattern.finditer(view), most)) for pattern, weight, most in _MARKS[name])


def points(text: str) -> dict[str, float]:
    """What the marks of the languages come to, of those that reach LEAST_SCORE in the whole text: half of it for the text as it is and half
    for the text with its strings emptied, so what only a string says counts half. Texts are read whole."""
    full = {name: p for name in MARKS if (p := _points(text, name)) >= LEAST_SCORE}
    if not full:
        return full
    bare = re.sub(r"'[^'\n]*'|\"[^\"\n]*\"", '""', text)
    return {name: (p + _points(bare, name)) / 2 for name, p in full.items()}


def language(text: str, hint: str | None = None) -> str:
    """The language with most points, the first in TIES among equals; text where none has LEAST_SCORE. A hint from who handed the text over decides."""
    if hint not in (None, "", "text", "unknown"):
        return hint
    ranked = sorted(points(text).items(), key=lambda x: (-x[1], TIES.index(x[0])))
    return ranked[0][0] if ranked and ranked[0][1] >= LEAST_SCORE else "text"


# -- gates and the fixed point


@lru_cache(maxsize=16)
def faults(text: str, lang: str) -> int:
    """Unbalanced brackets and open strings. Batch has no such structure."""
    if lang in ONCE:
        return 0
    strings = {"powershell": r"'(?:[^']|'')*'|\"(?:[^\"`]|`.|\"\")*\"|<#.*?#>|#[^\n]*", "javascript": _JS_STRING + r"|//[^\n]*|/\*.*?\*/", "vbscript": _VB_STRING + r"|'[^\n]*"}.get(lang, r"'(?:[^']|'')*'|\"(?:[^\"`]|`.|\"\")*\"|#[^\n]*")
    bare = re.sub(strings, "", text, flags=re.S)
    stack, bad = [], sum(bare.count(q) for q in ('"', "'")[: 1 if lang == "vbscript" else 2])
    pairs = {")": "(", "]": "[", "}": "{"}
    for c in bare:
        if c in "([{":
            stack.append(c)
        elif c in pairs:
            if stack and stack[-1] == pairs[c]:
                stack.pop()
            else:
                bad += 1
    return bad + len(stack)


def rewrite(text: str, lang: str, growth: int = 100) -> tuple[str, list[Change], int, bool]:
    """(final text, changes, rounds, whether it came to rest)."""
    rules = RULES.get(lang, RULES["text"])
    seen, changes = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}, []
    limit = max(1_000_000, growth * len(text))
    for n in range(1, MOST_ROUNDS + 1):
        start = text
        for k, (name, rule) in enumerate((*rules, *LAST.get(lang, ()))):
            if k >= len(rules) and text != start:
                break
            try:
                new = rule(text)
            except (RecursionError, ValueError, IndexError, OverflowError, re.error):
                continue  # one rule's failure is no failure of the text
            if new != text and len(new) <= limit and faults(new, lang) <= faults(text, lang):
                at = next((i for i, (a, b) in enumerate(zip(text, new)) if a != b), min(len(text), len(new)))
                changes.append(Change(n, name, text[max(0, at - 16) : at + 80], new[max(0, at - 16) : at + 80]))
                text = new
        if text == start or lang in ONCE:
            return text, changes, n, True
        mark = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
        if mark in seen:
            return text, changes, n, False
        seen.add(mark)
    return text, changes, MOST_ROUNDS, False


def variables(text: str, lang: str) -> dict[str, str]:
    if lang in ("powershell", "text", "unknown"):
        return {k: shown(v) for k, v in assigned(text).items()}
    if lang in ONCE:
        return batch.run(text, lang == "command")[1]
    found = {}
    for m in (_JS_DECLARE if lang == "javascript" else _VB_DECLARE).finditer(text):
        found[m.group(1)] = js_text(m.group(2)) if lang == "javascript" else vb_text(m.group(2))
    return found
