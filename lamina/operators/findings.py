"""Findings: first of equals, collapse of contained values, severity, order, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import values
from lamina.functions.text import defang
from lamina.operators.extract import indicators, signatures
from lamina.session import cut

#: Types of which a value within another of the same text says nothing new.
COLLAPSIBLE = ("user_agent", "registry_key", "mutex", "file_path", "unc_path")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == s, F.lit(3 - i)) for i, s in enumerate(values.SEVERITIES)), F.lit(0))


def severity_of(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind.isin(*[t for t, (s, _) in values.TYPES.items() if s == level]), F.lit(level)) for level in values.SEVERITIES))


def techniques_of(kind: Column) -> Column:
    named = {t: m for t, (_, m) in values.TYPES.items() if m}
    return F.coalesce(*(F.when(kind == t, F.array(*map(F.lit, m))) for t, m in named.items()), F.array().cast("array<string>"))


def first_of_equals(found: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """One row for each (keys, type, value without case): the first by `order`. Partial aggregation, no window."""
    rest = [c for c in found.columns if c not in (*keys, "type")]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_f")
    return found.groupBy(*keys, "type", F.lower("value").alias("_l")).agg(first).select(*keys, "type", "_f.*")


def without_pieces(found: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Without partial hashes that are a piece of a whole digest of the same text, and without collapsible values within another of
    their type and text. limit: more values of a type than that in one text aren't compared (None: always compared).

    Each text's findings are put together in one row, whose size its text bounds, judged there and taken apart again: one shuffle, and
    no finding is multiplied by the others."""
    rest = [c for c in found.columns if c not in keys]
    own = found.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_f"))
    digests = F.transform(F.filter("_f", lambda f: f["type"].isin("hash_md5", "hash_sha1", "hash_sha256")), lambda f: F.lower(f["value"]))
    peers = F.transform(F.filter("_f", lambda f: f["type"].isin(*COLLAPSIBLE)), lambda f: F.struct(f["type"].alias("type"), f["value"].alias("value")))
    judged = own.withColumns({"_d": digests, "_c": peers})

    def said_elsewhere(f: Column) -> Column:
        piece = (f["type"] == "hash_partial") & F.exists("_d", lambda d: F.contains(d, F.lower(f["value"])))
        inside = f["type"].isin(*COLLAPSIBLE) & F.exists("_c", lambda c: (c["type"] == f["type"]) & (c["value"] != f["value"]) & F.contains(c["value"], f["value"]))
        if limit is not None:
            inside = inside & (F.size(F.filter("_c", lambda c: c["type"] == f["type"])) <= limit)
        return F.coalesce(piece, F.lit(False)) | F.coalesce(inside, F.lit(False))

    return judged.select(*keys, F.inline(F.filter("_f", lambda f: ~said_elsewhere(f)))).select(*found.columns)


def scan(df: DataFrame, key: str | list[str], text: str, rules: bool = True, everything: bool = True) -> DataFrame:
    """All findings of a text column: key, type, value, severity, mitre, defanged_value."""
    keys = [key] if isinstance(key, str) else list(key)
    plain = indicators(df, keys, text, everything=everything).withColumns({"severity": severity_of(F.col("type")), "mitre": techniques_of(F.col("type"))})
    found = plain.unionByName(signatures(df, keys, text)) if rules else plain
    kept = without_pieces(first_of_equals(found, keys), keys)
    return kept.select(*keys, "type", "value", "severity", "mitre", defang(F.col("value"), F.col("type")).alias("defanged_value"))


def scan_order() -> list[Column]:
    """Severity, type and value, all falling."""
    return [severity_rank(F.col("severity")).desc(), F.col("type").desc(), F.lower("value").desc()]


def in_scan_order(found: DataFrame) -> DataFrame:
    """All findings in the order of a scan. The input is written first: a global sort samples it and would compute it twice."""
    return cut(found).orderBy(*scan_order())


def in_stored_order(found: DataFrame) -> DataFrame:
    """Severity falling, then type and value rising."""
    return found.orderBy(severity_rank(F.col("severity")).desc(), "type", "value")


def merge(*groups: DataFrame, keys: list[str]) -> DataFrame:
    """One list from several scans; what an earlier one has is kept from there."""
    every = None
    for i, g in enumerate(groups):
        g = g.withColumn("_o", F.lit(i))
        every = g if every is None else every.unionByName(g)
    return without_pieces(first_of_equals(every, keys, "_o").drop("_o"), keys)


def counts(found: DataFrame, by: list[str], column: str, kinds: tuple[str, ...]) -> DataFrame:
    """Fixed buckets, filled with zeros; the kinds are known, so no pass is needed to find them."""
    return found.groupBy(*by).agg(*(F.count_if(F.col(column) == k).alias(k) for k in kinds))


def techniques(found: DataFrame) -> DataFrame:
    """Findings for each technique, by name where it has one."""
    names = F.create_map(*(F.lit(x) for pair in values.TECHNIQUES.items() for x in pair))
    one = found.select(F.explode("mitre").alias("technique"))
    return one.groupBy("technique").agg(F.count(F.lit(1)).alias("findings")).select("technique", F.when(names[F.col("technique")].isNotNull(), F.concat_ws(" - ", "technique", names[F.col("technique")])).otherwise(F.col("technique")).alias("described"), "findings")


def entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Bits a character, from exact character counts: the sum runs over a text's distinct characters, which are few."""
    chars = F.split(text, "")
    counted = df.where(F.length(text) > 0).select(key, F.length(text).alias("n"), F.explode(chars).alias("c")).where("c <> ''").groupBy(key, "n", "c").agg(F.count(F.lit(1)).alias("k"))
    p = F.col("k") / F.col("n")
    return counted.groupBy(key).agg((-F.sum(p * F.log2(p))).alias("entropy"))
