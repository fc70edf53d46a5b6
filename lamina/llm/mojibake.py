"""Garbled text from a wrong character encoding (problem 6).

Method: characters are mapped back to the bytes of a legacy encoding, a
byte-structure automaton (compiled over the characters that stand for the
bytes) finds the maximal well-formed multibyte spans, and only those spans are
decoded. What a wrong decoding destroyed, or what mixed up two single-byte
encodings, is found by characters that can't stand where they stand.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.lookalike import SAME
from lamina.session import ship, spread, table

#: Single-byte encodings in which UTF-8 is commonly misread; undefined bytes stand for themselves.
PAGES = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp866")
#: Multi-byte ones.
WIDE = ("gbk", "big5", "cp932")


@lru_cache(maxsize=None)
def page(name: str) -> tuple[dict[str, int], re.Pattern]:
    """Characters to bytes, and the automaton of well-formed UTF-8 sequences over these characters."""
    to = {}
    for b in range(0x80, 0x100):
        if name == "cp1252":
            to[chr(b)] = b  # ISO 8859-1 reads C1 bytes as controls; both readings occur
        try:
            to[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            to[chr(b)] = b
    by: dict[int, list[str]] = {}
    for c, b in to.items():
        by.setdefault(b, []).append(c)

    def some(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for b in range(lo, hi + 1) for c in by.get(b, [])) + "]"

    tail = some(0x80, 0xBF)
    sequence = "|".join(
        (
            some(0xC2, 0xDF) + tail,
            some(0xE0, 0xE0) + some(0xA0, 0xBF) + tail,
            some(0xE1, 0xEC) + tail + "{2}",
            some(0xED, 0xED) + some(0x80, 0x9F) + tail,
            some(0xEE, 0xEF) + tail + "{2}",
            some(0xF0, 0xF0) + some(0x90, 0xBF) + tail + "{2}",
            some(0xF1, 0xF3) + tail + "{3}",
            some(0xF4, 0xF4) + some(0x80, 0x8F) + tail + "{2}",
        )
    )
    return to, re.compile(f"(?:{sequence})+")


def _usual(c: str) -> bool:
    """A character that texts in European and East Asian languages are made of."""
    o = ord(c)
    return (
        0xA0 <= o <= 0x17F or 0x0218 <= o <= 0x021B or 0x0400 <= o <= 0x045F or 0x0386 <= o <= 0x03CE and o != 0x0387 or 0x2010 <= o <= 0x203A or o in (0x20AC, 0x2122, 0x0490, 0x0491)
        or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xFF00 <= o <= 0xFFEF or 0xAC00 <= o <= 0xD7A3
    )


def _shown(c: str) -> bool:
    """An assigned character that isn't a control, a surrogate or for private use."""
    return unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs")


#: What follows a word in right texts: behind an accented or Cyrillic letter it proves nothing.
_CLOSING = frozenset("\u00a0»«”“’‘…—–°№")


def _proven(source: str, before: str, after: str, koi: bool) -> bool:
    """A sequence that can't be right writing, whatever character it decodes to."""
    if len(source) == 4:
        return not source.isalpha() or source.startswith("ЁЯ")  # emoji in code page 866; no word begins so
    if all(map(_letter, source)):
        greek = [0x370 <= ord(c) < 0x400 for c in source]
        cased = [c for c in source if c.islower() or c.isupper()]
        return len(source) > 2 and source[0] not in SAME and (any(greek) != all(greek) or any(a.islower() and b.isupper() for a, b in zip(cased, cased[1:])))
    cyrillic = ord(source[0]) >= 0x400 and source[0].isalpha()
    plain = all(c in _CLOSING or cyrillic and (c.islower() or "─" <= c <= "▟" and not koi) for c in source[1:])
    if cyrillic and before.isascii() and before.isalpha():
        return source[0] not in SAME
    if cyrillic:
        return not (before.isalpha() or "─" <= before <= "▟") and not all(c in _CLOSING for c in source[1:]) if plain or koi else True
    return not plain or source[0] in "âÔΓ‚" and not before.isalpha() or after.isalpha() and len(source) > 2


def _runs(span: str, to: dict[str, int], line: str, start: int, koi: bool) -> list[tuple[int, int, str]]:
    """The stretches of a well-formed span whose characters can be meant. Unusual ones must be proven: by themselves from three bytes, two-byte ones in a row."""
    parts, at = [], 0
    while at < len(span):
        n = 2 if to[span[at]] < 0xE0 else 3 if to[span[at]] < 0xF0 else 4
        parts.append((at, at + n, bytes(to[c] for c in span[at : at + n]).decode("utf-8")))
        at += n
    ok = []
    for i, (a, b, c) in enumerate(parts):
        source, joined = span[a:b], i > 0 and ok[-1]
        before, after = "" if joined else line[max(0, start + a - 1) : start + a], "" if i + 1 < len(parts) else line[start + b : start + b + 1]
        ok.append(_usual(c) or _shown(c) and (b - a > 2 or len(parts) > 1) and _proven(source, before, after, koi))
    for i, (a, b, c) in enumerate(parts):
        # A two-byte letter that proves nothing by itself counts beside two that do; a proven one not alone.
        near = [j for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(parts) and ok[j] and ord(parts[j][2]) >= 0x100]
        if not _usual(c) and b - a == 2 and _shown(c):
            ok[i] = bool(near) and (ok[i] or len(near) > 1)
    out = []
    for (a, b, c), good in zip(parts, ok):
        if good and out and out[-1][1] == a:
            out[-1] = (out[-1][0], b, out[-1][2] + c)
        elif good:
            out.append((a, b, c))
    return out


def _letter(c: str) -> bool:
    return c.isalpha() and ord(c) >= 0x80


def _doubtful(span: str, out: str, line: str, start: int, end: int) -> bool:
    """Two letters that have the structure by chance: a sequence of two letters that others surround proves nothing."""
    if len(out) != 1 or not all(map(_letter, span)):
        return False
    around = line[max(0, start - 1) : start] + line[end : end + 1]
    if ord(span[0]) >= 0x400:
        # Within a Latin word it is sure, but for letters that stand there for their looks.
        return not ("À" <= out <= "ſ" and re.search("[A-Za-z]", around) and not all(c in SAME for c in span))
    return span[0].isupper() == span[1].isupper() and any(ord(c) >= 0x80 for c in around)


def decode_line(line: str) -> tuple[str, int]:
    """One level of misreading undone in the encoding that explains most of the line; doubtful spans count only beside sure ones."""
    best, chosen = 0, None
    for name in PAGES:
        to, automaton = page(name)
        spans, sure = [], 0
        for m in automaton.finditer(line):
            for a, b, out in _runs(m.group(), to, line, m.start(), name == "koi8_r"):
                start, end = m.start() + a, m.start() + b
                spans.append((start, end, out))
                sure += 0 if all(map(_usual, out)) and _doubtful(line[start:end], out, line, start, end) else end - start
        if sure > best:
            best, chosen = sure, spans
    if not chosen:
        return line, 0
    parts, at = [], 0
    for start, end, out in chosen:
        parts += [line[at:start], out]
        at = end
    return "".join(parts) + line[at:], len(chosen)


_LINE = re.compile(r"[^\r\n]+")


def decode_spans(text: str) -> tuple[str, int]:
    """The text with its misread UTF-8 spans decoded, and their number; one level of misreading."""
    found = 0

    def put(m: re.Match) -> str:
        nonlocal found
        if m.group().isascii():
            return m.group()
        out, n = decode_line(m.group())
        found += n
        return out

    return _LINE.sub(put, text), found


_EAST = re.compile(r"[⺀-鿿가-힣豈-﫿-｡-ﾟ¡-ÿͰ-ӿ‐-◿]*[㐀-鿿-][⺀-鿿가-힣豈-﫿-｡-ﾟ¡-ÿͰ-ӿ‐-◿]*")


def decode_wide(text: str) -> tuple[str, int, int]:
    """The same for UTF-8 misread in a multi-byte encoding; also the number of spans of which a byte was lost."""
    found = lost = 0

    def put(m: re.Match) -> str:
        nonlocal found, lost
        span = m.group()
        inside = bool(re.match(r"[A-Za-z]", text[m.start() - 1 : m.start()] or "")) or bool(re.match(r"[A-Za-z]", text[m.end() : m.end() + 1]))
        for name in WIDE:
            try:
                raw = span.encode(name)
            except UnicodeEncodeError:
                continue
            try:
                out = raw.decode("utf-8")
            except UnicodeDecodeError as e:
                # A cut last sequence, of which the byte that paired with what followed is gone.
                if e.reason.startswith("unexpected end") and e.start >= 6 and all(0x3040 <= ord(c) <= 0x9FFF for c in raw[: e.start].decode("utf-8")):
                    lost += 1
                    return span
                continue
            if not all(_usual(c) or ord(c) >= 0x1F000 for c in out):
                continue
            latin = all(0xC0 <= ord(c) <= 0x17F for c in out)
            slavic = all(0x400 <= ord(c) <= 0x45F for c in out)
            eastern = all(0x3000 <= ord(c) <= 0x9FFF for c in out)
            if all(0x386 <= ord(c) <= 0x3CE for c in out) and len(out) > 2 or all(ord(c) >= 0x1F000 and _shown(c) for c in out):
                found += 1
                return out
            if (latin and (inside or len(out) > 2)) or (slavic and len(out) > 1) or (eastern and len(out) > 1):
                found += 1
                return out
        return span

    return _EAST.sub(put, text), found, lost


#: UTF-16 read in the other byte order: ASCII then has its code in the upper byte. Letters beyond ASCII may stand between.
_SWAPPED = re.compile("(?:[" + "".join(re.escape(chr(b << 8)) for b in (9, 10, 13, *range(32, 127))) + "]|[Ā-퟿-＀](?<=[" + "".join(chr(b << 8) for b in range(1, 216)) + "".join(chr(b << 8) for b in range(0xE0, 0x100)) + "])){4,}")


def decode_swapped(text: str) -> tuple[str, int]:
    found = 0

    def put(m: re.Match) -> str:
        nonlocal found
        out = m.group().encode("utf-16-le").decode("utf-16-be", "replace")
        if sum(c.isascii() for c in out) * 2 < len(out):
            return m.group()
        found += 1
        return out

    return _SWAPPED.sub(put, text), found


#: Characters that can't stand where they stand; see beyond_repair().
_IMPOSSIBLE = re.compile(
    "�"
    "|[\u0080-\u0084\u0086-\u009F]"
    "|[A-Za-z][¡-©«¬®-¶¸¹»-¿×÷ƒˆ˜†-•…‰‹›‚“-„€™ⁿ≤≥√≈⌐⌠⌡₧─-▟]+[a-z]"
    "|[a-z]{2}[‚„ⁿ⌠⌡▀-▓]"
    "|[a-z][À-ÖØ-ÞŠŒŽŸ][a-z]"
    "|[a-z]{2}[ÈÉÚŽΘ](?![A-Z])"
    "|(?:[a-z]|\\b)[ΘΩΣτΦΓφεσ][a-z]"
    "|[═-▟ⁿ][a-z]{2}"
    "|(?<![^\\W\\d_])[³¹¿¼¾][³¹]?[a-z]{2}(?<![¿][a-z]{2})"
    "|¿¹[a-z]"
    "|[a-z][³¹]+æ?\\b(?<=[æ])"
)
_ACCENTS = re.compile("[À-ÖØ-öø-ÿ]{4,}")


def mixed_up(text: str) -> tuple[str, int]:
    """Cyrillic of Windows-1251 read as Western letters: runs of four and more accented letters, without another letter between, decode to one case of Cyrillic."""
    found = 0

    def put(m: re.Match) -> str:
        nonlocal found
        out = m.group().encode("latin-1").decode("cp1251")
        if not all("А" <= c <= "я" for c in out) or not (out[1:].islower() or out.isupper()):
            return m.group()
        found += 1
        return out

    return _ACCENTS.sub(put, text), found


def repair(text: str | None) -> tuple[str | None, int, int]:
    """(restored text, passages restored, passages found but beyond repair). Several levels of misreading are undone one by one.

    A null text gives (None, 0, 0); ASCII and rightly decoded text come back as they are.
    """
    if text is None or text.isascii():
        return text, 0, 0
    fixed = lost = 0
    text, n = decode_swapped(text)
    fixed += n
    for _ in range(4):
        text, n = decode_spans(text)
        fixed += n
        if not n:
            break
    if _EAST.search(text):
        text, n, gone = decode_wide(text)
        fixed, lost = fixed + n, lost + gone
    text, n = mixed_up(text)
    fixed += n
    lost += sum(1 for _ in _IMPOSSIBLE.finditer(text))
    return text, fixed, lost


def garbled(df: DataFrame, key: str, fields: list[str], restored: bool = True) -> DataFrame:
    """One row for each key and field with a passage decoded wrongly: key, field, passages, lost, and restored (the text given back as it was written).

    Texts without a character outside ASCII are dropped before any Python is
    reached. Nulls and empty texts are no cases; a null key is kept; a key
    twice gives its rows twice; other columns are left out; an empty table
    gives no rows. Texts of any length are read whole.
    """
    ship(df.sparkSession)
    each = spread(df.select(key, *fields)).select(F.col(key).cast("long").alias("k"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("t")).select("k", "t.field", "t.text").where(F.col("text").rlike(r"[^\x00-\x7F]"))

    def run(batches):
        for b in batches:
            out = []
            for k, f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                text, fixed, lost = repair(t)
                if fixed or lost:
                    out.append((k, f, fixed, lost, text.encode("utf-8", "replace").decode() if restored else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["k", "field", "passages", "lost", "restored"])

    out = each.mapInArrow(run, "k long, field string, passages int, lost int, restored string").withColumnRenamed("k", key)
    return out if restored else out.drop("restored")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(table(spark, folder, "analyses"), "id", ["original_text", "deobfuscated_text"], restored=False).select(F.col("id").alias("analysis_id"), "field")


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(table(spark, folder, "analyses"), "id", ["original_text", "deobfuscated_text"]).withColumnRenamed("id", "analysis_id")


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored}
SQL: dict[str, str] = {}
