"""Indicators in texts: one pass over a text column gives (key, type, value, at).

Families that Java's regular expressions can say stay in Catalyst: all of a
text's matches are built as one array and exploded once, so a table is scanned
once whatever the number of families. The rest (checksums, IPv6 grammar, paths
by priority, names of artefacts) is one Arrow function, reached only by texts
that a cheap test lets through.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import checks, values
from lamina.functions.text import refang
from lamina.session import ship, spread

#: Families in Catalyst, in the order in which the first of equal findings is kept.
FAMILIES = {
    "ip_port": values.IP_PORT, "ip": values.IPV4, "user_agent": "(?U)" + values.USER_AGENT, "registry_key": "(?U)" + values.REGISTRY, "mutex": values.MUTEX, "url": "(?U)" + values.URL, "domain": values.DOMAIN, "email": values.EMAIL,
    "hash_sha256": values.SHA256, "hash_sha1": values.SHA1, "hash_md5": values.MD5, "hash_partial": values.HASH_PARTIAL,
}
_PAIR = "array<struct<type:string,value:string>>"


def _matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(FAMILIES[kind]), F.lit(0))
    if kind == "url":
        found = F.transform(found, lambda v: F.regexp_replace(v, "[.,;)]+$", ""))
    elif kind == "user_agent":
        found = F.transform(found, lambda v: F.trim(v))
    elif kind == "domain":
        found = F.filter(found, lambda v: F.lower(F.element_at(F.split(v, r"\."), -1)).isin(*values.TLDS))
    return F.transform(found, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def paths(text: str) -> list[tuple[str, str]]:
    """File and UNC paths: quoted ones first, unquoted ones where no quoted one is."""
    out, taken = [], []

    def put(value: str) -> None:
        value = value.rstrip(values.PATH_TAIL)
        if len(value) >= 4 and "\\" in value.lstrip("\\"):
            out.append(("unc_path" if value.startswith("\\\\") else "file_path", value))

    for m in re.finditer(values.QUOTED_PATH, text):
        insort(taken, m.span(1))
        put(m.group(1))
    for m in re.finditer(values.PATH, text):
        k = bisect_right(taken, (m.start(), len(text) + 1))
        if not (k and taken[k - 1][1] > m.start() or k < len(taken) and taken[k][0] < m.end()):
            put(m.group())
    return out


def checked(text: str | None) -> list[tuple[str, str]]:
    """The families that need more than a pattern."""
    if not text:
        return []
    out = []
    for m in re.finditer(values.IPV6_PORT, text):
        if checks.ipv6(m.group(1)) and 0 < int(m.group(2)) <= 65535:
            out += [("ipv6_port", m.group()), ("ip", m.group(1))]
    out += [("ip", m.group()) for m in re.finditer(values.IPV6, text) if checks.ipv6(m.group())]
    for pattern, test in ((values.BTC_BASE58, checks.base58check), (values.BTC_BECH32, checks.bech32), (values.ETH, bool), (values.XMR, bool)):
        out += [("crypto_wallet", m.group()) for m in re.finditer(pattern, text) if test(m.group())]
    out += paths(text)
    for kind, pattern in (("scheduled_task", values.TASK), ("service_name", values.SERVICE)):
        for m in re.finditer(pattern, text):
            if name := checks.artefact(next(filter(None, m.groups()), None)):
                out.append((kind, name))
    return out


def _checked(text: Column) -> Column:
    return F.pandas_udf(lambda texts: texts.map(lambda t: [{"type": a, "value": b} for a, b in checked(t)]), _PAIR)(text)


_WORTH = r"(?i)\\|%\w+%|:[0-9a-f]{0,4}:|0x[0-9a-f]{40}|bc1|[1348][1-9A-HJ-NP-Za-km-z]{25}|/tn|-TaskName|New-Service|\bsc(?:\.exe)?\s+create"


def indicators(df: DataFrame, key: str | list[str], text: str, kinds: list[str] | None = None, everything: bool = True) -> DataFrame:
    """Rows (key, type, value, at) for each match, in the refanged text; `at` counts a row's matches in the order of the families.

    kinds: only these families. everything=False leaves out the families beyond Catalyst. Null and empty texts give no rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    clean = spread(df.select(*keys, text)).select(*keys, refang(F.col(text)).alias("_t")).where(F.length("_t") > 0)
    parts = [_matches(F.col("_t"), k) for k in FAMILIES if kinds is None or k in kinds]
    if everything:
        ship(df.sparkSession)
        parts.append(F.when(F.col("_t").rlike(_WORTH), _checked(F.col("_t"))).otherwise(F.array().cast(_PAIR)))
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    out = clean.select(*keys, F.posexplode(every).alias("at", "m")).select(*keys, "m.type", "m.value", "at")
    return out if kinds is None else out.where(F.col("type").isin(*kinds))


def signatures(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """Rows (key, type, value, severity, mitre, at) for each rule that a text meets; the text as it is, not refanged. Rules are literals in the plan: no join."""
    keys = [key] if isinstance(key, str) else list(key)
    hits = F.array(*(F.when(F.col(text).rlike("(?i)" + pattern), F.struct(F.lit(name).alias("value"), F.lit(severity).alias("severity"), F.array(*map(F.lit, mitre)).alias("mitre"), F.lit(1000 + i).alias("at"))) for i, (name, severity, mitre, pattern) in enumerate(values.RULES)))
    return spread(df.select(*keys, text)).where(F.length(text) > 0).select(*keys, F.explode(F.array_compact(hits)).alias("m")).select(*keys, F.lit("signature").alias("type"), "m.*")
