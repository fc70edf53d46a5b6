"""Text projections as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFANGABLE = ("ip", "ip_port", "ipv6_port", "domain", "url", "email")


def refang(text: Column) -> Column:
    """Defanged writing undone, by five rules in this order."""
    t = F.regexp_replace(text, "(?i)hxxps", "https")
    t = F.regexp_replace(t, "(?i)hxxp", "http")
    t = F.regexp_replace(t, r"(?i)\[\.\]|\(\.\)|\[dot\]|\(dot\)", ".")
    t = F.regexp_replace(t, r"\[:\]|\(:\)", ":")
    return F.regexp_replace(t, r"(?i)\[@\]|\(@\)|\[at\]|\(at\)", "@")


def defang(value: Column, kind: Column) -> Column:
    """A value that can't be clicked: hxxp, [.] and [@]; IPv6 by its colons; types without a network meaning stay."""
    dotted = F.replace(F.replace(F.regexp_replace(value, "(?i)^http(s?)://", "hxxp$1://"), F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]"))
    colons = F.replace(F.replace(value, F.lit(":"), F.lit("[:]")), F.lit("."), F.lit("[.]"))
    six = kind.isin("ip", "ipv6_port") & (F.length(value) - F.length(F.replace(value, F.lit(":"), F.lit(""))) >= 2)
    return F.when(~kind.isin(*DEFANGABLE), value).when(six, colons).otherwise(dotted)


def powershell_lines(text: Column) -> Column:
    """Line feeds only, and lines joined that a backtick continues."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "`\n[ \t]*", " ")


def plain_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def batch_lines(text: Column) -> Column:
    """Line feeds only; a carriage return by itself is dropped."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit(""))


def tidy(text: Column) -> Column:
    """Lines without trailing blanks, one empty line at most between others, none at the ends."""
    t = F.regexp_replace(text, "[ \t\f\r]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def reserved_characters(text: Column) -> Column:
    """Characters that marks inside the engine are made of become replacement characters."""
    return F.translate(text, "\u0000", "���")


def preview(text: Column, size: int = 96) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(size))


def context(text: Column, at: Column, size: Column, radius: int = 40) -> Column:
    """The surroundings of a place (`at` counts from 1) on one line."""
    start = F.greatest(at - radius, F.lit(1))
    return F.trim(F.translate(F.substring(text, start, at + size + radius - start), "\n", " "))


def file_name(name: Column) -> Column:
    """A name safe to store: other characters become _, 200 at most, never empty."""
    return F.coalesce(F.nullif(F.left(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), F.lit(200)), F.lit("")), F.lit("upload"))


def extension_allowed(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin("ps1", "txt", "vbs", "js", "bat", "cmd", "log")


def spreadsheet_safe(value: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula; numbers stay."""
    return F.when(value.rlike(r"^[=+@\t\r-]") & value.try_cast("double").isNull(), F.concat(F.lit("'"), value)).otherwise(value)


def percent_decode(text: Column, plus: bool) -> Column:
    """Percent decoding; a plus is a blank (plus=True) or itself. Malformed input gives null."""
    return F.try_url_decode(text if plus else F.replace(text, F.lit("+"), F.lit("%2B")))


def printable_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x20-\x7e\t\r\n]", "")) / F.length(text)


def looks_encoded(text: Column) -> Column:
    """At least 40 characters of a Base64-like alphabet in two classes, and no digest."""
    classes = sum((text.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    return text.rlike(r"^[A-Za-z0-9+/=_-]{40,}\z") & ~text.rlike(r"^(?:[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64}|[A-Fa-f0-9]{96}|[A-Fa-f0-9]{128})\\z") & (classes >= 2)


def duration(ms: Column) -> Column:
    """3.33s, 1m 25.03s."""
    s = ms / 1000.0
    return F.when(s < 60, F.format_string("%.2fs", s)).otherwise(F.format_string("%dm %.2fs", F.floor(s / 60), s - 60 * F.floor(s / 60)))


def at_offset(epoch: Column, hours: Column) -> Column:
    """Epoch seconds shown at an offset from UTC; a session in UTC is assumed, as everywhere here."""
    return F.date_format(F.timestamp_seconds(epoch + hours * 3600), "yyyy-MM-dd HH:mm:ss")
