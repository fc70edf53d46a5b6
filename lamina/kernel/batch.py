"""cmd.exe text: percent expansion, carets, set, set /a, for, goto; a conservative reading line by line."""

from __future__ import annotations

import re
from collections import Counter

from lamina.functions.values import RUNTIME, RUNTIME_STARTS, STOCK

#: Limits of the command interpreter itself (a line, a value), and the items up to which a loop is written out.
MOST_LINE, MOST_VALUE, MOST_ITEMS = 8191, 32_767, 256


def wrap(n: int) -> int:
    """Signed 32 bits."""
    return (n + 2**31) % 2**32 - 2**31


class Unknown(Exception):
    pass


_ARITH = re.compile(r"\s*(0[xX][0-9a-fA-F]+|\d+|[A-Za-z_]\w*|<<|>>|[-+*/%()&|^~!])")


def calculate(text: str, variables: dict[str, str]) -> int:
    """One expression of set /a. Numbers may be hexadecimal or octal; an undefined name is 0."""
    toks, at = [], 0
    while at < len(text.rstrip()):
        m = _ARITH.match(text, at)
        if not m:
            raise Unknown
        toks.append(m.group(1))
        at = m.end()
    pos = 0

    def number(t: str) -> int:
        try:
            return int(t, 16) if t[:2] in ("0x", "0X") else int(t, 8) if len(t) > 1 and t[0] == "0" else int(t)
        except ValueError:
            raise Unknown from None

    def unary() -> int:
        nonlocal pos
        if pos >= len(toks):
            raise Unknown
        t = toks[pos]
        pos += 1
        if t == "(":
            v = level(0)
            if pos >= len(toks) or toks[pos] != ")":
                raise Unknown
            pos += 1
            return v
        if t in "-+~!":
            v = unary()
            return wrap({"-": -v, "+": v, "~": ~v, "!": int(not v)}[t])
        if t[0].isdigit():
            return wrap(number(t))
        if t[0].isalpha() or t[0] == "_":
            value = variables.get(t.lower(), "0")
            if value is None:
                raise Unknown
            return wrap(number(value.strip())) if re.fullmatch(r"\s*\d\w*\s*", value) else -wrap(number(value.strip()[1:])) if re.fullmatch(r"\s*-\d\w*\s*", value) else 0
        raise Unknown

    levels = (("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))

    def level(k: int) -> int:
        nonlocal pos
        if k == len(levels):
            return unary()
        v = level(k + 1)
        while pos < len(toks) and toks[pos] in levels[k]:
            op = toks[pos]
            pos += 1
            w = level(k + 1)
            if op in "/%" and w == 0:
                raise Unknown
            if op in ("<<", ">>"):
                v = wrap(v << (w & 31)) if op == "<<" else v >> (w & 31)
            elif op in "/%":
                q = abs(v) // abs(w) * (1 if (v < 0) == (w < 0) else -1)
                v = wrap(q if op == "/" else v - q * w)
            else:
                v = wrap({"|": v | w, "^": v ^ w, "&": v & w, "+": v + w, "-": v - w, "*": v * w}[op])
        return v

    out = level(0)
    if pos != len(toks):
        raise Unknown
    return out


def modified(value: str, how: str) -> str:
    """%v:~start,length% and %v:old=new% (or *old)."""
    if how.startswith("~"):
        m = re.fullmatch(r"~(-?\d+)(?:,(-?\d+))?", how)
        if not m:
            raise Unknown
        n = len(value)
        a = int(m.group(1))
        a = max(0, n + a) if a < 0 else min(a, n)
        b = n if m.group(2) is None else int(m.group(2)) + (n if int(m.group(2)) < 0 else a)
        return value[a : max(a, min(b, n))]
    old, eq, new = how.partition("=")
    if not eq or not old:
        raise Unknown
    if old.startswith("*"):
        k = value.lower().find(old[1:].lower())
        return value if k < 0 else new + value[k + len(old) - 1 :]
    return re.sub(re.escape(old), lambda _: new, value, flags=re.I)


_REFERENCE = re.compile(r"%(?P<name>[^%:]+)(?::(?P<how>[^%]*))?%|%(?P<begun>[^%:]+):")
_ARGUMENT = re.compile(r"%(?:\*|~[A-Za-z$:]*[0-9A-Za-z]|\d)")


def machine(name: str) -> str | None:
    """The stock value of a variable of the machine; "" for one that only the machine knows; None for a name that isn't the machine's."""
    name = name.lower()
    if f"env:{name}" in STOCK:
        return STOCK[f"env:{name}"]
    return "" if name in RUNTIME or name.startswith(RUNTIME_STARTS) else None


def expand(line: str, variables: dict[str, str | None], command_line: bool = False, double: bool = False) -> str:
    """Percent expansion. variables: a value, or None where it can't be known. In a file %% is one percent sign, a lone one vanishes and a name
    never set stands for nothing (of %name:...% only `%name:` goes); on a command line all of these stay, and
    with double=True %% alone. A line that grows beyond MOST_LINE stays as written."""
    out, at = [], 0
    while (k := line.find("%", at)) >= 0:
        out.append(line[at:k])
        if line.startswith("%%", k):
            out.append("%%" if command_line or double else "%")
            at = k + 2
            continue
        if m := _ARGUMENT.match(line, k):
            out.append(m.group())
            at = m.end()
            continue
        m = _REFERENCE.match(line, k)
        if m is None:
            out.append("%" if command_line else "")
            at = k + 1
            continue
        name, how = (m.group("name") or m.group("begun")).lower(), m.group("how")
        known = machine(name) if name not in variables else variables[name]
        at = m.end()
        if known is None and name not in variables and not command_line:  # never set
            at = k + 2 + len(name) if how is not None or m.group("begun") else m.end()
        elif not known or m.group("begun"):
            out.append(m.group())
        else:
            try:
                out.append(modified(known, how) if how is not None else known)
            except Unknown:
                out.append(m.group())
    out.append(line[at:])
    done = "".join(out)
    return line if len(done) > max(MOST_LINE, len(line)) else done


_DELAYED = re.compile(r"!([A-Za-z_#$][\w#$.@-]*)(?::(~-?\d+(?:,-?\d+)?|[^!=\n]+=[^!\n]*))?!")


def expand_delayed(line: str, variables: dict[str, str | None]) -> str:
    """!name! where delayed expansion is on."""

    def put(m: re.Match) -> str:
        value = variables.get(m.group(1).lower())
        try:
            return m.group() if value is None else modified(value, m.group(2)) if m.group(2) else value
        except Unknown:
            return m.group()

    return _DELAYED.sub(put, line)


def carets(line: str) -> str:
    """Outside quotes a caret vanishes and what follows it is a plain character; one at the end of a line, which joins lines, stays."""
    return re.sub(r"(\"[^\"]*(?:\"|$))|\^(.)", lambda m: m.group(1) or m.group(2), line, flags=re.S)


_SET = re.compile(r"^\s*@?set\s+(?:\"([^\"=]+)=([^\"]*)\"\s*$|([^\s\"=/][^=]*?)=(.*))$", re.I)
_SET_A = re.compile(r"^\s*@?set\s+/a\s+\"?([^\"]*)\"?\s*$", re.I)
_SET_P = re.compile(r"^\s*@?set\s+/p\s+\"?([\w#$.]+)=", re.I)
_FOR_L = re.compile(r"^(\s*@?)for\s+/l\s+%%?([A-Za-z])\s+in\s+\(\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\)\s+do\s+(.+)$", re.I)
_BRANCH = re.compile(r"^\s*@?(?:if|goto|call|exit|for|else|\)|:)", re.I)


def assign_all(text: str, variables: dict[str, str | None]) -> None:
    """set /a a=1+2, b+=3: every part in its order; a part beyond calculation makes its name unknown."""
    for part in text.split(","):
        m = re.match(r"\s*([A-Za-z_]\w*)\s*(<<|>>|[-+*/%&|^])?=\s*(.*)$", part)
        if not m:
            continue
        name, op, body = m.group(1).lower(), m.group(2), m.group(3)
        try:
            variables[name] = str(calculate(f"{m.group(1)}{op}({body})" if op else body, {k: v for k, v in variables.items() if v is not None}))
        except (Unknown, RecursionError):
            variables[name] = None


_JUMP = re.compile(r"\b(?:goto\s+:?|call\s+:)([^\s:&|<>()]+)", re.I)
_GOTO = re.compile(r"^\s*@?goto\s+:?([^\s:&|<>()]+)\s*$", re.I)
_LABEL = re.compile(r"^\s*:([^\s:&|<>()]+)")
_SETS = re.compile(r"\bset\s+(?:/[ap]\s+)?\"?([\w#$.]+)\s*(?:[-+*/%&|^]|<<|>>)?=", re.I)
_LOOP = re.compile(r"^\s*@?for\b", re.I)


class _Reading:
    """One pass over a file. What a branch may or may not have set, and what a label can be reached with, isn't known."""

    def __init__(self, text: str, command_line: bool):
        self.lines, self.command_line = text.split("\n"), command_line
        self.variables: dict[str, str | None] = {}
        self.branched, self.delayed, self.scopes, self.depth = False, False, [], 0
        self.jumps = Counter(m.group(1).lower() for line in self.lines for m in _JUMP.finditer(line))
        self.labels = {m.group(1).lower(): i for i, line in reversed(list(enumerate(self.lines))) if (m := _LABEL.match(line)) and not line.lstrip().startswith("::")}
        self.set_by = [{n.lower() for n in _SETS.findall(line)} for line in self.lines]

    def read(self) -> str:
        out, i = [], 0
        while i < len(self.lines):
            line = self.lines[i]
            out.append(self.line(line.rstrip("\r"), i) + ("\r" if line.endswith("\r") else ""))
            m = _GOTO.match(line.rstrip("\r"))
            to = self.labels.get(m.group(1).lower()) if m and not self.depth else None
            if to is not None and to > i and not self.branched:
                # Straight on behind the label; what lies between isn't run from here and stays as written.
                out += self.lines[i + 1 : to]
                self.jumps[m.group(1).lower()] -= 1
                i = to
            else:
                i += 1
        return "\n".join(out)

    def forget(self, names) -> None:
        self.variables.update(dict.fromkeys(names))

    def line(self, line: str, at: int) -> str:
        if re.match(r"\s*@?(?:rem\b|::)", line, re.I):
            return line
        if m := _LABEL.match(line):
            if self.jumps[m.group(1).lower()] > 0 or self.branched:
                self.branched = True
                self.forget(n for names in self.set_by for n in names)
            return line
        # A loop that isn't written out keeps the doubled percent signs of its variable.
        loop = _LOOP.match(line) is not None
        plain = carets(expand(line, self.variables, self.command_line, double=loop))
        items = loop_values(plain) if loop else None
        if items is not None and not self.depth and not any(x.lstrip().startswith("(") or _JUMP.search(x) for x in items):
            return "\n".join(self.command(x) for x in items)
        return self.command(plain)

    def command(self, plain: str) -> str:
        """One command, percent signs and carets done: delayed expansion, and what it does to the variables."""
        plain = expand_delayed(plain, self.variables) if self.delayed else plain
        if re.match(r"\s*@?setlocal\b", plain, re.I):
            self.scopes.append((dict(self.variables), self.delayed))
            self.delayed = self.delayed or re.search(r"\benabledelayedexpansion\b", plain, re.I) is not None
        elif re.match(r"\s*@?endlocal\b", plain, re.I):
            if self.scopes:
                self.variables, self.delayed = self.scopes.pop()
        elif self.depth or _BRANCH.match(plain):
            self.branched = self.branched or not _GOTO.match(plain)
            self.forget(n.lower() for n in _SETS.findall(plain))
            bare = re.sub(r'"[^"]*"', "", plain)
            self.depth = max(0, self.depth + bare.count("(") - bare.count(")"))
        elif (m := _SET_A.match(plain)) is not None:
            assign_all(m.group(1), self.variables)
        elif (m := _SET_P.match(plain)) is not None:
            self.forget([m.group(1).lower()])
        elif (m := _SET.match(plain)) is not None and not re.match(r"\s*@?set\s+/", plain, re.I):
            name, value = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4))
            self.assign(name.strip().lower(), value)
        return plain

    def assign(self, name: str, value: str) -> None:
        # Beyond a branch a line may not have run, so two values are possible.
        if self.branched or len(value) > MOST_VALUE or re.search("%[^%]+%|!", value) and (self.delayed or "%" in value):
            self.variables[name] = None
        elif value:
            self.variables[name] = value
        else:
            self.variables.pop(name, None)


def run(text: str, command_line: bool = False) -> tuple[str, dict[str, str]]:
    """(text with what is known put in, variables known at the end)."""
    r = _Reading(text, command_line)
    return r.read(), {k: v for k, v in r.variables.items() if v is not None}


def resolve(text: str) -> str:
    return run(text)[0]


def resolve_command(text: str) -> str:
    return run(text, command_line=True)[0]


_FOR_LIST = re.compile(r"^(\s*@?)for\s+%%?([A-Za-z])\s+in\s+\(([^()*?]*)\)\s+do\s+(.+)$", re.I)
_FOR_F = re.compile(r"^(\s*@?)for\s+/f\s+(?:\"([^\"]*)\"\s+)?%%?([A-Za-z])\s+in\s+\(\s*\"([^\"]*)\"\s*\)\s+do\s+(.+)$", re.I)


def _filled(body: str, name: str, value: str) -> str:
    return re.sub(rf"%%?(?:~[a-z]*)?{name}\b", lambda _: value, body)


def loop_values(line: str) -> list[str] | None:
    """The commands that a FOR over a constant range, list or literal stands for; None for anything else, such as files or the output of a command."""
    if m := _FOR_L.match(line):
        a, step, b = int(m.group(3)), int(m.group(4)), int(m.group(5))
        if step == 0 or abs(b - a) // abs(step) > MOST_ITEMS:
            return None
        return [_filled(m.group(6), m.group(2), str(v)) for v in range(a, b + (1 if step > 0 else -1), step)]
    if m := _FOR_LIST.match(line):
        items = re.findall(r"\"[^\"]*\"|[^\s,;=]+", m.group(3))
        return [_filled(m.group(4), m.group(2), v) for v in items] if len(items) <= MOST_ITEMS and "%" not in m.group(3) else None
    if m := _FOR_F.match(line):
        options = dict(re.findall(r"(tokens|delims|skip|eol)=(\S*)", m.group(2) or "", re.I))
        if "skip" in options:
            return None
        by = options.get("delims", " \t")
        parts = [p for p in re.split("[" + re.escape(by) + "]+", m.group(4)) if p] if by else [m.group(4)]
        wanted = options.get("tokens", "1")
        body, name = m.group(5), m.group(3)
        for k, t in enumerate(wanted.split(",")):
            letter = chr(ord(name) + k)
            if t == "*":
                body = _filled(body, letter, m.group(4))
            elif t.isdigit():
                body = _filled(body, letter, parts[int(t) - 1] if 0 < int(t) <= len(parts) else "")
            else:
                return None
        return [body]
    return None
