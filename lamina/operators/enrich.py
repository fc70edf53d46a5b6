"""What is known about findings: scope, categories of addresses, verdicts, the cache, geography."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import checks, values
from lamina.functions.text import refang
from lamina.session import ship

DAY = 86_400


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 as a number; null for anything else."""
    p = F.split(ip, r"\.")
    n = reduce(lambda a, b: a * 256 + b, (p[i].cast("long") for i in range(4)))
    return F.when(ip.rlike(rf"^{values.IPV4}\z"), n)


def _within(n: Column, *nets: str) -> Column:
    import ipaddress

    ranges = [ipaddress.ip_network(x) for x in nets]
    return reduce(lambda a, b: a | b, (n.between(int(r.network_address), int(r.broadcast_address)) for r in ranges))


def ipv4_category(ip: Column) -> Column:
    """The first that holds of: invalid, documentation, loopback, link-local, multicast, private, reserved, public. Integer arithmetic only."""
    n = ip_number(ip)
    return (
        F.when(n.isNull(), "invalid")
        .when(_within(n, "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"), "documentation")
        .when(_within(n, "127.0.0.0/8"), "loopback")
        .when(_within(n, "169.254.0.0/16"), "link-local")
        .when(_within(n, "224.0.0.0/4"), "multicast")
        .when(_within(n, "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4"), "private")
        .when(_within(n, "100.64.0.0/10"), "reserved")
        .otherwise("public")
    )


def any_ip_category(ip: Column) -> Column:
    return F.pandas_udf(lambda ips: ips.map(checks.ip_category), "string")(ip)


def ip_category(df: DataFrame, ip: str, into: str = "category") -> DataFrame:
    """The category of IPv4 (in Catalyst) and IPv6 (in Arrow) addresses."""
    ship(df.sparkSession)
    return df.withColumn(into, F.when(F.col(ip).contains(":"), any_ip_category(F.col(ip))).otherwise(ipv4_category(F.col(ip))))


def stripped(value: Column) -> Column:
    """Without the blanks at its ends: tabs, line ends and Unicode's spaces too, which trim leaves."""
    blank = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return F.regexp_replace(value, rf"\A{blank}|{blank}\z", "")


def host_of(value: Column) -> Column:
    h = F.regexp_replace(stripped(value), r"(?s)\A.*?://", "")
    h = F.regexp_replace(F.regexp_replace(h, r"(?s)[/?].*\z", ""), r"(?s)\A.*@", "")
    h = F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)", 1)).when(F.length(h) - F.length(F.replace(h, F.lit(":"), F.lit(""))) == 1, F.regexp_replace(h, r"(?s):.*\z", "")).otherwise(h)
    return F.lower(F.regexp_replace(stripped(h), r"\.+\z", ""))


def skip_reason(kind: Column, value: Column) -> Column:
    """Why a finding can't be asked about, or null: partial_hash, local_rule, reserved_suffix, single_label."""
    host = host_of(value)
    named = kind.isin("domain", "url", "email") & (host != "")
    return (
        F.when(kind == "hash_partial", "partial_hash")
        .when((kind == "signature") & value.isin(*(r[0] for r in values.RULES)), "local_rule")
        .when(named & host.contains(".") & F.element_at(F.split(host, r"\."), -1).isin(*values.RESERVED_SUFFIXES), "reserved_suffix")
        .when(named & ~host.contains("."), "single_label")
    )


def classify(value: Column) -> Column:
    """The type of a value by itself, in whole; null for none. IPv6 apart, which needs its grammar."""
    v = refang(stripped(value))
    full = lambda p: v.rlike(f"^(?:{p})\\z")
    return (
        F.when(full(values.IPV4), "ip")
        .when(full("(?U)" + values.URL), "url")
        .when(full(values.SHA256), "hash_sha256")
        .when(full(values.SHA1), "hash_sha1")
        .when(full(values.MD5), "hash_md5")
        .when(full(values.DOMAIN) & F.lower(F.element_at(F.split(v, r"\."), -1)).isin(*values.TLDS), "domain")
    )


def resolve_type(value: Column, requested: Column) -> Column:
    """The type to look a value up as: what is asked for, or what the value looks like."""
    v, found = refang(stripped(value)), classify(value)
    digest = F.when(v.rlike(r"^[A-Za-z0-9]+\z"), F.when(F.length(v) == 32, "hash_md5").when(F.length(v) == 40, "hash_sha1").when(F.length(v) == 64, "hash_sha256"))
    return F.when(v == "", None).when(requested.isin("", "auto"), found).when(requested == "signature", "signature").when(requested == "hash", digest).when(requested.isin("ip", "domain", "url"), requested)


def capabilities(findings: DataFrame, kind: str = "type") -> DataFrame:
    """Each finding with each source that can be asked about its type: an array literal, no join."""
    pairs = F.array_compact(F.array(*(F.when(F.col(kind).isin(*types), F.lit(source)) for source, types in values.CAPABILITY.items())))
    return findings.withColumn("provider", F.explode(pairs))


def cached(findings: DataFrame, cache: DataFrame, now: float, ttl: float = DAY) -> DataFrame:
    """Findings (source, type, value, ...) with the cache's verdict of the same source, type and value without case, if it isn't older than ttl.

    An equi-join: the age is a filter on the cache's side, so it reaches the scan.
    """
    fresh = cache.where((F.lit(now) - F.col("fetched_at") <= ttl) & F.col("verdict").isin(*values.CACHEABLE)).select("source", F.col("ioc_type").alias("type"), F.col("value").alias("_l"), "verdict", "detail", "fetched_at")
    return findings.withColumn("_l", F.lower("value")).join(fresh, ["source", "type", "_l"], "left").drop("_l")


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest answer for each (source, ioc_type, value without case)."""
    every = cache.unionByName(fresh.withColumn("value", F.lower("value")))
    rest = [c for c in cache.columns if c not in ("source", "ioc_type", "value")]
    return every.groupBy("source", "ioc_type", "value").agg(F.max_by(F.struct(*rest), "fetched_at").alias("r")).select("source", "ioc_type", "value", "r.*")


def rank(verdict: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(verdict == v, F.lit(i)) for i, v in enumerate(order)), F.lit(len(order)))


def worst_for_report(intel: DataFrame, key: str = "finding_id") -> DataFrame:
    """One verdict a finding by the report's order; answers that are mere context don't count. Also how many sources agree, of how many."""
    v = F.lower(F.trim(F.col("verdict")))
    scored = intel.withColumn("v", v).where(F.col("v") != "info")
    known = F.col("v").isin(*values.REPORT_ORDER)
    worst = scored.groupBy(key).agg(F.min(F.when(known, rank(F.col("v"), values.REPORT_ORDER))).alias("r"), F.count(F.lit(1)).alias("sources"), *(F.count_if(F.col("v") == x).alias(f"n{i}") for i, x in enumerate(values.REPORT_ORDER)))
    named = F.coalesce(*(F.when(F.col("r") == i, F.lit(x)) for i, x in enumerate(values.REPORT_ORDER)), F.lit("unknown"))
    agreeing = F.coalesce(*(F.when(F.col("r") == i, F.col(f"n{i}")) for i in range(len(values.REPORT_ORDER))), F.lit(0))
    return worst.select(key, named.alias("verdict"), agreeing.alias("agreeing"), "sources")


def worst_for_table(intel: DataFrame, key: str = "finding_id") -> DataFrame:
    """One verdict a finding by the table's order; what wasn't checked doesn't count."""
    v = F.lower(F.trim(F.col("verdict")))
    scored = intel.where((F.col("source") != "scope") & (v != "not_checked"))
    order = values.TABLE_ORDER
    worst = scored.groupBy(key).agg(F.min(rank(v, order)).alias("r"))
    return worst.select(key, F.coalesce(*(F.when(F.col("r") == i, F.lit(x)) for i, x in enumerate(order)), F.lit("unknown")).alias("verdict"))


_ANSWER = (
    "struct<data:string,pulse_info:struct<count:int>,classification:string,risk:string,tags:array<string>,vulns:array<string>,ports:array<int>,query_status:string>"
)
_DATA = "struct<attributes:struct<last_analysis_stats:struct<malicious:int,suspicious:int,harmless:int,undetected:int>>,abuseConfidenceScore:int,totalReports:int>"


def provider_verdict(provider: Column, body: Column, kind: Column | None = None) -> Column:
    """The verdict behind a provider's stored JSON answer (thresholds as the providers' own scales), about a finding of a kind. The body is read
    once; what is no JSON has nothing in it."""
    a = F.from_json(body, _ANSWER)
    d = F.from_json(a["data"], _DATA)
    num = lambda c: F.coalesce(c, F.lit(0))
    stats = d["attributes"]["last_analysis_stats"]
    m, s, h, u = (num(stats[x]) for x in ("malicious", "suspicious", "harmless", "undetected"))
    vt = F.when(m > 0, "malicious").when(s > 0, "suspicious").when(m + s + h + u > 0, "clean").otherwise("unknown")
    score, reports = num(d["abuseConfidenceScore"]), num(d["totalReports"])
    abuse = F.when(score >= 75, "malicious").when(score >= 25, "suspicious").when(reports > 0, "clean").otherwise("unknown")
    pulses = num(a["pulse_info"]["count"])
    otx = F.when(pulses >= 3, "malicious").when(pulses >= 1, "suspicious").otherwise("unknown")
    c = F.lower(a["classification"])
    grey = F.when(c == "malicious", "malicious").when(c == "benign", "clean").when(c == "suspicious", "suspicious").otherwise("unknown")
    r = F.lower(a["risk"])
    pulse = F.when(r.isin("critical", "high"), "malicious").when(r == "medium", "suspicious").when(r.isin("low", "none"), "clean").otherwise("unknown")
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    shodan = F.when(some(a["tags"]) | some(a["vulns"]), "suspicious").when(some(a["ports"]), "clean").otherwise("unknown")
    return (
        F.when(provider == "virustotal", vt).when(provider == "abuseipdb", abuse).when(provider == "otx", otx).when(provider == "greynoise", grey).when(provider == "pulsedive", pulse).when(provider == "shodan", shodan)
        .when(provider == "abusech", _malware_verdict(a["query_status"], a["data"], F.lit("url") if kind is None else kind)).otherwise("unknown")
    )


def _malware_verdict(status: Column, data: Column, kind: Column) -> Column:
    """Samples and families are listed with entries and say why they have none; URLs, addresses and names are listed or not."""
    sample, family = kind.isin("hash_md5", "hash_sha1", "hash_sha256"), kind == "signature"
    none = F.when(sample, status == "hash_not_found").otherwise(status.isin("signature_not_found", "no_results"))
    listed = F.coalesce(data.isNotNull() & ~data.isin("[]", "null"), F.lit(False))
    entries = F.when(none, "unknown").when(F.coalesce(status != "ok", F.lit(True)), "error").when(listed, "malicious").otherwise("unknown")
    return F.when(sample | family, entries).when(kind.isin("url", "ip", "domain"), F.when(status == "ok", "malicious").otherwise("unknown")).otherwise("not_checked")


def locate(ips: DataFrame, ip: str, blocks: DataFrame, widths: list[int] | None = None) -> DataFrame:
    """The most specific block (net_lo LONG, prefix INT, ...) of each IPv4 address; null columns where none is.

    A range join made an equi-join: an address can only be in the one network
    of each prefix length in use (at most 33), so it is joined by its network
    numbers, each side hashed, and the longest prefix kept by partial
    aggregation. No side has to fit a broadcast and no pair is tried in vain.
    """
    widths = widths or sorted(r[0] for r in blocks.select("prefix").distinct().limit(34).collect())  # at most 33 lengths exist
    attributes = [c for c in blocks.columns if c not in ("net_lo", "prefix")]
    n = ip_number(F.col(ip))
    distinct = ips.select(ip).distinct()
    nets = distinct.select(ip, F.explode(F.array(*(F.struct(F.lit(w).alias("prefix"), F.shiftleft(F.shiftright(n, 32 - w), 32 - w).alias("net_lo")) for w in widths))).alias("k")).select(ip, "k.*") if widths else distinct.select(ip, F.lit(0).alias("prefix"), F.lit(None).cast("long").alias("net_lo"))
    best = nets.join(blocks, ["prefix", "net_lo"]).groupBy(ip).agg(F.max_by(F.struct("prefix", *attributes), "prefix").alias("b")).select(ip, "b.*")
    return ips.join(best, ip, "left")


def rate_windows(calls: DataFrame, provider: str, ts: str, seconds: int = 60, most: int = 4) -> DataFrame:
    """Each call with the number of calls of its provider in the trailing window, and whether it would have had to wait.

    Providers are few, so time is cut into slices of 64 windows and a task sorts a slice. A call within a window of the next slice's
    start is given to that slice too, to be counted and not kept."""
    width = 64 * seconds
    t = F.col(ts).cast("timestamp").cast("double")
    own = F.floor(t / width)
    slices = F.when(t >= (own + 1) * width - seconds, F.array(F.struct(own.alias("_s"), F.lit(True).alias("_own")), F.struct((own + 1).alias("_s"), F.lit(False).alias("_own")))).otherwise(F.array(F.struct(own.alias("_s"), F.lit(True).alias("_own"))))
    dealt = calls.select("*", t.alias("_t"), F.inline(slices))
    w = Window.partitionBy(provider, "_s").orderBy("_t").rangeBetween(-seconds, 0)
    counted = dealt.withColumn("in_window", F.count(F.lit(1)).over(w))
    return counted.where("_own").select(*calls.columns, "in_window", (F.col("in_window") > most).alias("waits"))


def as_of(events: DataFrame, facts: DataFrame, keys: list[str], ts: str, fact_ts: str) -> DataFrame:
    """Each event with the newest fact of its keys that isn't later: one union, one sort, no pair of rows formed."""
    values_ = [c for c in facts.columns if c not in keys]
    left = events.withColumns({"_t": F.col(ts), "_o": F.lit(1)}).withColumn("_f", F.lit(None).cast(facts.select(F.struct(*values_)).schema[0].dataType))
    right = facts.select(*keys, F.col(fact_ts).alias("_t"), F.lit(0).alias("_o"), F.struct(*values_).alias("_f"))
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    every = left.unionByName(right, allowMissingColumns=True).withColumn("_f", F.last("_f", ignorenulls=True).over(w))
    return every.where("_o = 1").select(*events.columns, *(F.col(f"_f.{c}").alias(f"fact_{c}") for c in values_))
