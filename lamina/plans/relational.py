"""Queries of the relational half, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.functions import values as V
from lamina.operators import enrich, extract, findings, history
from lamina.session import table
from lamina.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = 1_780_000_000.0


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_REFANG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'hxxps', 'https', 'gi'), 'hxxp', 'http', 'gi'), '\\[\\.\\]|\\(\\.\\)|\\[dot\\]|\\(dot\\)', '.', 'gi'), '\\[:\\]|\\(:\\)', ':', 'g'), '\\[@\\]|\\(@\\)|\\[at\\]|\\(at\\)', '@', 'gi')"
_TLDS = ", ".join(f"'{t}'" for t in V.TLDS)
_FORMS = {"ip": V.IPV4, "ip_port": V.IP_PORT, "registry_key": V.REGISTRY, "mutex": V.MUTEX, "url": V.URL, "domain": V.DOMAIN, "email": V.EMAIL, "hash_sha256": V.SHA256, "hash_sha1": V.SHA1, "hash_md5": V.MD5, "hash_partial": V.HASH_PARTIAL}


def _family_sql(kind: str, source: str, key: str, column: str) -> str:
    value = "regexp_replace(v, '[.,;)]+$', '')" if kind == "url" else "v"
    where = f"WHERE lower(split_part(v, '.', -1)) IN ({_TLDS})" if kind == "domain" else ""
    return f"SELECT {key}, '{kind}' AS type, {value} AS value FROM (SELECT {key}, unnest(regexp_extract_all({_REFANG.format(column)}, {_q(_FORMS[kind])})) AS v FROM {source} WHERE length({column}) > 0) {where}"


def _family(kind: str):
    def run(spark, folder):
        return extract.indicators(table(spark, folder, "documents"), "doc_id", "text", [kind], everything=False).groupBy("doc_id", "type", "value").agg(F.count(F.lit(1)).alias("hits"))

    return run


for _kind in _FORMS:
    query(f"ioc_{_kind}_documents", f"SELECT doc_id, type, value, count(*) AS hits FROM ({_family_sql(_kind, 'documents', 'doc_id', 'text')}) GROUP BY ALL")(_family(_kind))

_ALL = " UNION ALL ".join(_family_sql(k, "documents", "doc_id", "text") for k in _FORMS)
_ORDER = [k for k in extract.FAMILIES if k in _FORMS]


def _plain(spark, folder):
    return extract.indicators(table(spark, folder, "documents"), "doc_id", "text", list(_FORMS), everything=False)


@query("ioc_first_wins", f"SELECT doc_id, type, lower(value) AS folded, count(*) AS hits FROM ({_ALL}) GROUP BY ALL")
def ioc_first_wins(spark, folder):
    found = _plain(spark, folder)
    hits = found.groupBy("doc_id", "type", F.lower("value").alias("folded")).agg(F.count(F.lit(1)).alias("hits"))
    first = findings.first_of_equals(found, ["doc_id"]).select("doc_id", "type", F.lower("value").alias("folded"))
    return first.join(hits, ["doc_id", "type", "folded"])


@query("ioc_type_counts", f"SELECT type, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM ({_ALL}) GROUP BY type")
def ioc_type_counts(spark, folder):
    return _plain(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))


@query("ioc_rollup", f"SELECT source, lang, type, count(*) AS findings FROM ({_ALL}) JOIN documents USING (doc_id) GROUP BY ROLLUP (source, lang, type)")
def ioc_rollup(spark, folder):
    found = extract.indicators(table(spark, folder, "documents"), ["doc_id", "source", "lang"], "text", list(_FORMS), everything=False)
    return found.rollup("source", "lang", "type").agg(F.count(F.lit(1)).alias("findings"))


@query("ioc_partial_not_in_digest", f"WITH f AS (SELECT DISTINCT doc_id, type, lower(value) AS value FROM ({_ALL})) SELECT doc_id, value FROM f WHERE type = 'hash_partial' AND NOT EXISTS (SELECT 1 FROM f d WHERE d.doc_id = f.doc_id AND d.type IN ('hash_md5', 'hash_sha1', 'hash_sha256') AND contains(d.value, f.value))")
def ioc_partial_not_in_digest(spark, folder):
    kept = findings.without_pieces(findings.first_of_equals(_plain(spark, folder), ["doc_id"]), ["doc_id"])
    return kept.where("type = 'hash_partial'").select("doc_id", F.lower("value").alias("value"))


@query("scan_documents")
def scan_documents(spark, folder):
    return findings.scan(table(spark, folder, "documents"), "doc_id", "text")


@query("scan_documents_first")
def scan_documents_first(spark, folder):
    """The hundred findings that a report of all documents would begin with; ties by document. A bounded heap in each task, no global sort."""
    found = findings.scan(table(spark, folder, "documents"), "doc_id", "text")
    return found.orderBy(*findings.scan_order(), "doc_id", "value").limit(100)


@query("scan_analyses")
def scan_analyses(spark, folder):
    a = table(spark, folder, "analyses")
    parts = [findings.scan(a.where(F.length(c) > 0), "id", c) for c in ("deobfuscated_text", "original_text")]
    return findings.merge(*parts, keys=["id"])


_SIGNATURES = " UNION ALL ".join(f"SELECT id, {_q(n)} AS value, '{s}' AS severity FROM analyses WHERE regexp_matches(original_text, {_q('(?i)' + p)})" for n, s, _, p in V.RULES)


@query("signature_hits", _SIGNATURES)
def signature_hits(spark, folder):
    return extract.signatures(table(spark, folder, "analyses"), "id", "original_text").select("id", "value", "severity")


@query("signature_techniques", "WITH s AS (" + _SIGNATURES + "), m AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(n)}, '{t}')" for n, _, m, _ in V.RULES for t in m) + ") AS m(value, technique)) SELECT technique, CASE " + " ".join(f"WHEN technique = '{t}' THEN {_q(t + ' - ' + n)}" for t, n in V.TECHNIQUES.items()) + " ELSE technique END AS described, count(*) AS findings FROM s JOIN m USING (value) GROUP BY 1, 2")
def signature_techniques(spark, folder):
    return findings.techniques(extract.signatures(table(spark, folder, "analyses"), "id", "original_text"))


@query("refang_findings", f"SELECT id, {_REFANG.format('value')} AS value FROM findings")
def refang_findings(spark, folder):
    return table(spark, folder, "findings").select("id", T.refang(F.col("value")).alias("value"))


@query("defang_findings", "SELECT id, CASE WHEN type NOT IN ('ip', 'ip_port', 'ipv6_port', 'domain', 'url', 'email') THEN value WHEN type IN ('ip', 'ipv6_port') AND length(value) - length(replace(value, ':', '')) >= 2 THEN replace(replace(value, ':', '[:]'), '.', '[.]') ELSE replace(replace(regexp_replace(value, '^http(s?)://', 'hxxp\\1://', 'i'), '.', '[.]'), '@', '[@]') END AS value FROM findings")
def defang_findings(spark, folder):
    return table(spark, folder, "findings").select("id", T.defang(F.col("value"), F.col("type")).alias("value"))


_BLANK = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '\\A{_BLANK}+|{_BLANK}+\\z', '', 'g')"


# Java's \s of a Unicode pattern, which RE2's isn't.
_URL_ALL = V.URL.replace(r"[^\s", "[^" + _BLANK[1:-1])


@query("classify_findings", f"WITH v AS (SELECT id, {_REFANG.replace('{0}', _stripped('value'))} AS v FROM findings) SELECT id, CASE WHEN regexp_full_match(v, {_q(V.IPV4)}) THEN 'ip' WHEN regexp_full_match(v, {_q(_URL_ALL)}) THEN 'url' WHEN regexp_full_match(v, {_q(V.SHA256)}) THEN 'hash_sha256' WHEN regexp_full_match(v, {_q(V.SHA1)}) THEN 'hash_sha1' WHEN regexp_full_match(v, {_q(V.MD5)}) THEN 'hash_md5' WHEN regexp_full_match(v, {_q(V.DOMAIN)}) AND lower(split_part(v, '.', -1)) IN ({_TLDS}) THEN 'domain' END AS kind FROM v")
def classify_findings(spark, folder):
    return table(spark, folder, "findings").select("id", enrich.classify(F.col("value")).alias("kind"))


# An IPv6 address in full or with one gap, without an IPv4 tail.
_V6 = r"(?i)(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?"
_NUM = "CAST(split_part(value, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(value, '.', 2) AS BIGINT) * 65536 + CAST(split_part(value, '.', 3) AS BIGINT) * 256 + CAST(split_part(value, '.', 4) AS BIGINT)"


def _in(*nets: str) -> str:
    import ipaddress

    return " OR ".join(f"n BETWEEN {int(r.network_address)} AND {int(r.broadcast_address)}" for r in map(ipaddress.ip_network, nets))


@query(
    "ip_categories",
    f"WITH v AS (SELECT id, value, CASE WHEN regexp_full_match(value, {_q(V.IPV4)}) THEN {_NUM.replace('CAST', 'TRY_CAST')} END AS n FROM findings WHERE type = 'ip') SELECT id, value, CASE WHEN regexp_full_match(value, {_q(_V6)}) THEN CASE WHEN regexp_full_match(lower(value), '2001:0?db8:.*') THEN 'documentation' WHEN value = '::1' THEN 'loopback' WHEN regexp_full_match(lower(value), 'fe[89ab][0-9a-f]:.*') THEN 'link-local' WHEN regexp_full_match(lower(value), 'ff[0-9a-f]{{2}}:.*') THEN 'multicast' WHEN regexp_full_match(lower(value), 'f[cd][0-9a-f]{{2}}:.*') THEN 'private' ELSE 'public' END WHEN n IS NULL THEN 'invalid' WHEN {_in('192.0.2.0/24', '198.51.100.0/24', '203.0.113.0/24')} THEN 'documentation' WHEN {_in('127.0.0.0/8')} THEN 'loopback' WHEN {_in('169.254.0.0/16')} THEN 'link-local' WHEN {_in('224.0.0.0/4')} THEN 'multicast' WHEN {_in('0.0.0.0/8', '10.0.0.0/8', '172.16.0.0/12', '192.0.0.0/29', '192.0.0.170/31', '192.168.0.0/16', '198.18.0.0/15', '240.0.0.0/4')} THEN 'private' WHEN {_in('100.64.0.0/10')} THEN 'reserved' ELSE 'public' END AS category FROM v",
)
def ip_categories(spark, folder):
    return enrich.ip_category(table(spark, folder, "findings").where("type = 'ip'").select("id", "value"), "value")


_HOST = _stripped("value")
for _pattern in (r"\A.*?://", r"[/?].*\z", r"\A.*@"):
    _HOST = f"regexp_replace({_HOST}, '{_pattern}', '', 's')"
_BARE_HOST = _stripped(r"CASE WHEN starts_with(h, '[') THEN regexp_extract(h, '^\[([^\]]*)', 1) WHEN length(h) - length(replace(h, ':', '')) = 1 THEN split_part(h, ':', 1) ELSE h END")
_RULE_NAMES = ", ".join(_q(n) for n, *_ in V.RULES)


@query("scope_skips", rf"WITH h AS (SELECT id, type, value, {_HOST} AS h FROM findings), g AS (SELECT *, lower(regexp_replace({_BARE_HOST}, '\.+\z', '')) AS host FROM h) SELECT id, CASE WHEN type = 'hash_partial' THEN 'partial_hash' WHEN type = 'signature' AND value IN ({_RULE_NAMES}) THEN 'local_rule' WHEN type IN ('domain', 'url', 'email') AND host <> '' AND contains(host, '.') AND split_part(host, '.', -1) IN ('invalid', 'example', 'test', 'localhost', 'local', 'internal') THEN 'reserved_suffix' WHEN type IN ('domain', 'url', 'email') AND host <> '' AND NOT contains(host, '.') THEN 'single_label' END AS reason FROM g")
def scope_skips(spark, folder):
    return table(spark, folder, "findings").select("id", enrich.skip_reason(F.col("type"), F.col("value")).alias("reason"))


@query("provider_requests", "SELECT provider, count(*) AS findings FROM findings JOIN (VALUES " + ", ".join(f"('{p}', '{t}')" for p, ts in V.CAPABILITY.items() for t in ts) + ") AS c(provider, type) USING (type) GROUP BY provider")
def provider_requests(spark, folder):
    return enrich.capabilities(table(spark, folder, "findings")).groupBy("provider").agg(F.count(F.lit(1)).alias("findings"))


@query("cache_hits", f"SELECT i.id, c.verdict AS cached FROM finding_intel i JOIN findings f ON f.id = i.finding_id LEFT JOIN (SELECT * FROM intel_cache WHERE {NOW} - fetched_at <= 86400 * 400 AND verdict IN ('malicious', 'suspicious', 'clean', 'unknown')) c ON c.source = i.source AND c.ioc_type = f.type AND c.value = lower(f.value)")
def cache_hits(spark, folder):
    asked = table(spark, folder, "finding_intel").select("id", "finding_id", "source").join(table(spark, folder, "findings").select(F.col("id").alias("finding_id"), "type", "value"), "finding_id")
    return enrich.cached(asked, table(spark, folder, "intel_cache"), NOW, enrich.DAY * 400).select("id", F.col("verdict").alias("cached"))


_V = "lower(trim(verdict))"


def _rank_sql(order):
    return "CASE " + " ".join(f"WHEN {_V} = '{v}' THEN {i}" for i, v in enumerate(order)) + " END"


def _name_sql(order):
    return "CASE r " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(order)) + " ELSE 'unknown' END"


@query("verdict_report", f"WITH s AS (SELECT finding_id, min({_rank_sql(V.REPORT_ORDER)}) AS r, count(*) AS sources, list({_V}) AS vs FROM finding_intel WHERE {_V} <> 'info' GROUP BY finding_id) SELECT finding_id, {_name_sql(V.REPORT_ORDER)} AS verdict, CASE WHEN r IS NULL THEN 0 ELSE len(list_filter(vs, lambda x: x = {_name_sql(V.REPORT_ORDER)})) END AS agreeing, sources FROM s")
def verdict_report(spark, folder):
    return enrich.worst_for_report(table(spark, folder, "finding_intel"))


@query("verdict_table", f"WITH s AS (SELECT finding_id, min({_rank_sql(V.TABLE_ORDER)}) AS r FROM finding_intel WHERE {_V} <> 'not_checked' AND source <> 'scope' GROUP BY finding_id) SELECT finding_id, {_name_sql(V.TABLE_ORDER)} AS verdict FROM s")
def verdict_table(spark, folder):
    return enrich.worst_for_table(table(spark, folder, "finding_intel"))


@query("rate_limit_windows", "SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 4 AS waits FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)")
def rate_limit_windows(spark, folder):
    return enrich.rate_windows(table(spark, folder, "events"), "event_type", "ts").select("event_id", "in_window", "waits")


_COUNTED = "SELECT a.id, a.created_at, a.batch_id, count(f.id) AS finding_count, coalesce(sum(CASE WHEN f.severity = 'high' THEN 1 ELSE 0 END), 0) AS high_count FROM analyses a LEFT JOIN findings f ON f.analysis_id = a.id GROUP BY a.id, a.created_at, a.batch_id"


@query("analysis_counts", f"SELECT id, finding_count, CAST(high_count AS BIGINT) AS high_count FROM ({_COUNTED})")
def analysis_counts(spark, folder):
    return history.with_counts(table(spark, folder, "analyses").select("id"), table(spark, folder, "findings")).select("id", "finding_count", "high_count")


_HISTORY = f"WITH c AS ({_COUNTED}), b AS (SELECT id, arg_max(coalesce(completed_at, started_at), (completed_at IS NOT NULL, completed_at, duration_ms, status)) AS created_at FROM batches GROUP BY id), m AS (SELECT batch_id AS id, count(*) AS files, sum(finding_count) AS fc, sum(high_count) AS hc FROM c WHERE batch_id IS NOT NULL GROUP BY batch_id) SELECT 'single' AS kind, id, created_at, CAST(1 AS BIGINT) AS files, CAST(finding_count AS BIGINT) AS finding_count, CAST(high_count AS BIGINT) AS high_count FROM c WHERE batch_id IS NULL UNION ALL SELECT 'batch', b.id, b.created_at, coalesce(files, 0), CAST(coalesce(fc, 0) AS BIGINT), CAST(coalesce(hc, 0) AS BIGINT) FROM b LEFT JOIN m USING (id)"


def _history(spark, folder):
    return history.history(table(spark, folder, "analyses"), table(spark, folder, "findings"), table(spark, folder, "batches"))


@query("history_entries", _HISTORY)
def history_entries(spark, folder):
    return _history(spark, folder)


@query("history_newest", f"SELECT * FROM ({_HISTORY}) ORDER BY created_at DESC NULLS LAST, kind, id LIMIT 50")
def history_newest(spark, folder):
    return history.newest(_history(spark, folder), 50)


@query("retention_beyond", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS n FROM analyses) WHERE n > 100")
def retention_beyond(spark, folder):
    return history.beyond(table(spark, folder, "analyses").select("id", "created_at"), 100).select("id")


@query("batch_rollup", f"SELECT batch_id, id, CAST(sum(finding_count) AS BIGINT) AS finding_count, CAST(sum(high_count) AS BIGINT) AS high_count, grouping(batch_id, id) AS level FROM ({_COUNTED}) GROUP BY ROLLUP (batch_id, id)")
def batch_rollup(spark, folder):
    return history.batch_rollup(table(spark, folder, "analyses"), table(spark, folder, "findings"))


@query("batches_without_members", "SELECT id, count(*) AS states FROM batches WHERE id NOT IN (SELECT batch_id FROM analyses WHERE batch_id IS NOT NULL) GROUP BY id")
def batches_without_members(spark, folder):
    return history.empty_batches(table(spark, folder, "batches"), table(spark, folder, "analyses")).groupBy("id").agg(F.count(F.lit(1)).alias("states"))


def _buckets(column, kinds):
    return "SELECT analysis_id, " + ", ".join(f"count(*) FILTER ({column} = '{k}') AS {k}" for k in kinds) + " FROM findings GROUP BY analysis_id"


@query("severity_counts", _buckets("severity", V.SEVERITIES))
def severity_counts(spark, folder):
    return findings.counts(table(spark, folder, "findings"), ["analysis_id"], "severity", V.SEVERITIES)


@query("triage_counts", _buckets("triage_status", V.TRIAGE))
def triage_counts(spark, folder):
    return findings.counts(table(spark, folder, "findings"), ["analysis_id"], "triage_status", V.TRIAGE)


@query("triage_merge", "WITH l AS (SELECT type, value, arg_max(triage_status, id) AS s FROM findings WHERE triage_status <> 'unreviewed' GROUP BY type, value) SELECT id, coalesce(s, 'unreviewed') AS triage_status FROM findings LEFT JOIN l USING (type, value)")
def triage_merge(spark, folder):
    f = table(spark, folder, "findings")
    log = f.where("triage_status <> 'unreviewed'").groupBy("type", "value").agg(F.max_by("triage_status", "id").alias("triage_status"))
    return history.triage(f.select("id", "type", "value"), log).select("id", "triage_status")


@query("layer_counts", "SELECT analysis_id, layer, count(*) AS findings FROM findings GROUP BY ALL")
def layer_counts(spark, folder):
    return history.layer_counts(table(spark, folder, "findings"))


@query("entropy_documents", "WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0), k AS (SELECT doc_id, n, c, count(*) AS k FROM c WHERE c <> '' GROUP BY ALL) SELECT doc_id, round(-sum(k / n * log2(k / n)), 4) AS entropy FROM k GROUP BY doc_id")
def entropy_documents(spark, folder):
    return findings.entropy(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.round("entropy", 4).alias("entropy"))


@query("geo_locate", f"WITH v AS (SELECT DISTINCT value, {_NUM} AS n FROM findings WHERE type = 'ip' AND regexp_full_match(value, {_q(V.IPV4)})), b AS (SELECT 167772160 + i * 65536 AS lo, 16 AS p, 'net-' || i AS label FROM range(0, 256, 2) t(i) UNION ALL SELECT 167772160, 8, 'all' UNION ALL SELECT 167772160 + i * 256, 24, 'lab-' || i FROM range(0, 65536, 97) t(i)) SELECT value, arg_max(label, p) AS label FROM v LEFT JOIN b ON n BETWEEN lo AND lo + CAST(2 ** (32 - p) AS BIGINT) - 1 GROUP BY value")
def geo_locate(spark, folder):
    ips = table(spark, folder, "findings").where((F.col("type") == "ip") & F.col("value").rlike(f"^{V.IPV4}\\z")).select("value").distinct()
    net = lambda step, stop, width, shift, name: spark.range(0, stop, step).select((F.lit(167772160) + F.col("id") * shift).alias("net_lo"), F.lit(width).alias("prefix"), F.concat(F.lit(name), F.col("id").cast("string")).alias("label"))
    blocks = net(2, 256, 16, 65536, "net-").unionByName(spark.range(1).select(F.lit(167772160).cast("long").alias("net_lo"), F.lit(8).alias("prefix"), F.lit("all").alias("label"))).unionByName(net(97, 65536, 24, 256, "lab-"))
    return enrich.locate(ips, "value", blocks, [8, 16, 24]).select("value", "label")


@query("csv_guard", "SELECT id, CASE WHEN regexp_matches(value, '^[=+@\\t\\r-]') AND TRY_CAST(value AS DOUBLE) IS NULL THEN '''' || value ELSE value END AS value FROM findings")
def csv_guard(spark, folder):
    return sinks.guarded(table(spark, folder, "findings").select("id", "value"))


@query("file_names", "SELECT id, coalesce(nullif(left(regexp_replace(filename, '[^A-Za-z0-9._-]', '_', 'g'), 200), ''), 'upload') AS name, coalesce(regexp_matches(lower(filename), '\\.(ps1|txt|vbs|js|bat|cmd|log)$'), false) AS allowed FROM analyses")
def file_names(spark, folder):
    return table(spark, folder, "analyses").select("id", T.file_name(F.col("filename")).alias("name"), F.coalesce(T.extension_allowed(F.col("filename")), F.lit(False)).alias("allowed"))


@query("submission_limits", "WITH s AS (SELECT batch_id, id, filename, octet_length(encode(original_text)) AS size, CASE WHEN NOT coalesce(regexp_matches(lower(coalesce(filename, 'x.txt')), '\\.(ps1|txt|vbs|js|bat|cmd|log)$'), false) THEN 'type' WHEN octet_length(encode(original_text)) = 0 THEN 'empty' WHEN octet_length(encode(original_text)) > 3000 THEN 'size' END AS own FROM analyses WHERE batch_id IS NOT NULL), r AS (SELECT *, count(CASE WHEN own IS NULL THEN 1 END) OVER w AS n, sum(CASE WHEN own IS NULL THEN size ELSE 0 END) OVER w AS b FROM s WINDOW w AS (PARTITION BY batch_id ORDER BY id ROWS UNBOUNDED PRECEDING)) SELECT id, CASE WHEN n > 10 THEN 'count' WHEN b > 12000 THEN 'budget' ELSE own END AS skip_reason FROM r")
def submission_limits(spark, folder):
    files = table(spark, folder, "analyses").where("batch_id IS NOT NULL").select(F.col("batch_id").alias("submission"), F.col("id").alias("ord"), F.coalesce("filename", F.lit("x.txt")).alias("name"), F.encode("original_text", "UTF-8").alias("content"))
    return history.submission(files, 10, 3000, 12000).select(F.col("ord").alias("id"), "skip_reason")


@query("durations", "SELECT id, CASE WHEN duration_ms / 1000 < 60 THEN printf('%.2fs', duration_ms / 1000) ELSE printf('%dm %.2fs', CAST(floor(duration_ms / 60000) AS BIGINT), duration_ms / 1000 - 60 * floor(duration_ms / 60000)) END AS shown FROM analyses WHERE duration_ms IS NOT NULL")
def durations(spark, folder):
    return table(spark, folder, "analyses").where("duration_ms IS NOT NULL").select("id", T.duration(F.col("duration_ms")).alias("shown"))


@query("plain_lines", "SELECT id, regexp_replace(original_text, '\\r\\n?', chr(10), 'g') AS plain, replace(replace(original_text, chr(13) || chr(10), chr(10)), chr(13), '') AS batch FROM analyses")
def plain_lines(spark, folder):
    return table(spark, folder, "analyses").select("id", T.plain_lines(F.col("original_text")).alias("plain"), T.batch_lines(F.col("original_text")).alias("batch"))


@query("printable_shares", "SELECT id, round(length(regexp_replace(original_text, '[^\\x20-\\x7e\\t\\r\\n]', '', 'g')) / length(original_text), 6) AS share FROM analyses WHERE length(original_text) > 0")
def printable_shares(spark, folder):
    return table(spark, folder, "analyses").where("length(original_text) > 0").select("id", F.round(T.printable_share(F.col("original_text")), 6).alias("share"))


@query("event_rates", "SELECT date_trunc('minute', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_rates(spark, folder):
    from lamina.streaming.intake import rates

    e = table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rates(e, "at", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events")


@query("as_of_events", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fact_event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL UNION ALL SELECT event_id, NULL FROM events WHERE user_id IS NULL OR ts IS NULL")
def as_of_events(spark, folder):
    """Each event with the one before it, by time and id; an event asks from just below its own place, so it isn't its own fact."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts")
    facts = e.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.struct("ts", "event_id").alias("place"), "event_id")
    asked = e.withColumn("asks", F.struct("ts", (F.col("event_id") - 1).cast(e.schema["event_id"].dataType).alias("event_id")))
    return enrich.as_of(asked, facts, ["user_id"], "asks", "place").select("event_id", "fact_event_id")


@query("finding_export", "SELECT f.id, CASE WHEN type NOT IN ('ip', 'ip_port', 'ipv6_port', 'domain', 'url', 'email') THEN value WHEN type IN ('ip', 'ipv6_port') AND length(value) - length(replace(value, ':', '')) >= 2 THEN replace(replace(value, ':', '[:]'), '.', '[.]') ELSE replace(replace(regexp_replace(value, '^http(s?)://', 'hxxp\\1://', 'i'), '.', '[.]'), '@', '[@]') END AS defanged_value, coalesce(v.verdict, 'not checked') AS verdict FROM findings f LEFT JOIN (" + SQL["verdict_table"] + ") v ON v.finding_id = f.id")
def finding_export(spark, folder):
    rows = sinks.finding_rows(table(spark, folder, "findings").select("id", "type", "value"), enrich.worst_for_table(table(spark, folder, "finding_intel")))
    return rows.select("id", "defanged_value", "verdict")


@query("json_reports")
def json_reports(spark, folder):
    return sinks.reports(table(spark, folder, "analyses"), table(spark, folder, "findings"))
