"""Round trips and cases for every operator of the rewriting half that the stored tables show too little of.

A round trip goes over a whole table: the query hides a column (in an
encoding, an expression, a script, a stage), our operator has to bring it
back, and the SQL just selects the column. Where an input can't be made from
a column, the cases are written out, with what must come of them as VALUES.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import zlib

from pyspark.sql import functions as F

from lamina.functions import checks
from lamina.functions import values as V
from lamina.operators import enrich, findings, reports
from lamina.operators import layers as L
from lamina.operators import surveys as S
from lamina.plans.rewriting import _HALF, _LINE, _b64, _codes
from lamina.session import ship, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _q(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def lit(*parts):
    """Columns and plain text put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# -- rewriting: part.p_name hidden in one line


def trip(name: str, language: str, made, shown: str = "'$x = ''' || p_name || ''''", where: str = "true"):
    def run(spark, folder):
        ship(spark)
        df = spread(table(spark, folder, "part").where(where))
        return df.select(F.col("p_partkey").cast("long").alias("key"), L.rewritten(made(F.col("p_name")), F.lit(language)).alias("text"))

    query(name, f"SELECT CAST(p_partkey AS BIGINT) AS key, {shown} AS text FROM part WHERE {where}")(run)


def _each(c, before: str, after: str, sep: str, key: int = 0):
    return F.array_join(F.transform(F.split(c, ""), lambda x: lit(before, (F.ascii(x).bitwiseXOR(F.lit(key))).cast("string"), after)), sep)


def _hexed(c, before: str):
    return F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", before + "$1")


def _listed(c, sep: str):
    return F.replace(c, F.lit(" "), F.lit(sep))


_CODES7 = "array_to_string(list_transform(string_split(p_name, ''), lambda x: xor(ascii(x), 7)), ',')"
trip("ps_dash_split", "powershell", lambda c: lit("$x = ('", _listed(c, ","), "' -split ',') -join ' '"))
trip("ps_dash_replace", "powershell", lambda c: lit("$x = '", F.replace(c, F.lit("e"), F.lit("#1")), "' -replace '#1','e'"))
trip("ps_pipeline", "powershell", lambda c: lit("$x = (", _codes(c), " | %{ [char]$_ }) -join ''"))
trip("ps_byte_array", "powershell", lambda c: lit("$x = [Text.Encoding]::ASCII.GetString([byte[]](", _codes(c), "))"))
trip("ps_string_join", "powershell", lambda c: lit("$x = [string]::Join(' ',('", _listed(c, "','"), "'))"))
trip("ps_text_methods", "powershell", lambda c: lit("$x = '", c, "'.ToUpper().ToLower().Insert(0,'zz').Remove(0,2).PadLeft(200).TrimStart().Substring(0)"), "'$x = ''' || lower(p_name) || ''''")
trip("ps_xor_characters", "powershell", lambda c: lit("$x = -join (", _each(c, "[char](", " -bxor 7)", ",", 7), ")"))
trip("ps_xor_loop", "powershell", lambda c: lit("$b = ", _each(c, "", "", ",", 7), "\nfor ($i = 0; $i -lt $b.Length; $i++) { $b[$i] = $b[$i] -bxor 7 }"), f"'$b = ' || {_CODES7} || chr(10) || '$b = ''' || p_name || ''''")
trip("ps_interpolated", "powershell", lambda c: lit("$a = '", c, "'\n$x = \"<$a>\" + '!'"), "'$a = ''' || p_name || '''' || chr(10) || '$x = ''<' || p_name || '>!'''")
trip("ps_subexpression", "powershell", lambda c: lit("$x = \"$('", _HALF(c)[0], "' + '", _HALF(c)[1], "')\" + ''"))
trip("ps_aliases", "powershell", lambda c: lit("iwr '", c, "'"), "'Invoke-WebRequest ''' || p_name || ''''")
trip("ps_call_literal", "powershell", lambda c: lit("& 'Write-Host' '", c, "'"), "'Write-Host ''' || p_name || ''''")
trip("ps_stock_variable", "powershell", lambda c: lit("$x = $ShellId[1] + $ShellId[13] + 'x ", c, "'"), "'$x = ''iex ' || p_name || ''''")
trip("ps_string_cast", "powershell", lambda c: lit("$x = [string]'", c, "'"))
trip("ps_quotes_in_strings", "powershell", lambda c: lit("$x = 'a – ", c, "'"), "'$x = ''a – ' || p_name || ''''")
trip("ps_search_in_place", "powershell", lambda c: lit("$x = '", _b64(F.encode(lit(_LINE, _listed(c, "-"), " now and then"), "UTF-8")), "'"), f"'$x = ''{_LINE}' || replace(p_name, ' ', '-') || ' now and then'''")
trip("js_split_join", "javascript", lambda c: lit("var x = '", _listed(c, "-"), "'.split('-').join(' ');"), "'var x = ''' || p_name || ''';'")
trip("js_substring", "javascript", lambda c: lit("var x = 'zz", c, "zz'.substring(2, ", (F.length(c) + 2).cast("string"), ");"), "'var x = ''' || p_name || ''';'")
trip("js_slice", "javascript", lambda c: lit("var x = 'zz", c, "zz'.slice(2, -2);"), "'var x = ''' || p_name || ''';'")
trip("js_case", "javascript", lambda c: lit("var x = '", c, "'.toUpperCase().toLowerCase();"), "'var x = ''' || lower(p_name) || ''';'")
trip("js_replace", "javascript", lambda c: lit("var x = '#", c, "'.replace('#', '');"), "'var x = ''' || p_name || ''';'")
trip("js_escapes", "javascript", lambda c: lit("var x = '", _hexed(c, r"\\x"), "';"), "'var x = ''' || p_name || ''';'")
trip("js_members", "javascript", lambda c: lit("o['run']('", c, "');"), "'o.run(''' || p_name || ''');'")
trip("js_variables", "javascript", lambda c: lit("var a = '", c, "';\nvar x = a + '!';"), "'var a = ''' || p_name || ''';' || chr(10) || 'var x = ''' || p_name || '!'';'")
trip("vbs_replace", "vbscript", lambda c: lit('x = Replace("', F.replace(c, F.lit("e"), F.lit("#1")), '", "#1", "e")'), "'x = \"' || p_name || '\"'")
trip("vbs_case", "vbscript", lambda c: lit('x = LCase(UCase("', c, '"))'), "'x = \"' || lower(p_name) || '\"'")
trip("vbs_left_right", "vbscript", lambda c: lit('x = Left("', c, 'zz", ', F.length(c).cast("string"), ") & Right(\"", c, '", 0)'), "'x = \"' || p_name || '\"'")
trip("vbs_split_join", "vbscript", lambda c: lit('x = Join(Split("', _listed(c, "-"), '", "-"), " ")'), "'x = \"' || p_name || '\"'")
trip("vbs_continued", "vbscript", lambda c: lit('x = "', _HALF(c)[0], '" & _\n    "', _HALF(c)[1], '"'), "'x = \"' || p_name || '\"'")
trip("vbs_plus", "vbscript", lambda c: lit('x = "', _HALF(c)[0], '" + "', _HALF(c)[1], '"'), "'x = \"' || p_name || '\"'")
trip("vbs_named_tab", "vbscript", lambda c: lit('x = "', c, '" & vbTab'), "'x = \"' || p_name || chr(9) || '\"'")
trip("vbs_variables", "vbscript", lambda c: lit('a = "', c, '"\nx = a & "!"'), "'a = \"' || p_name || '\"' || chr(10) || 'x = \"' || p_name || '!\"'")
trip("batch_undefined", "batch", lambda c: lit("echo %zqv%", c, "%zqw:~0,2 50%%"), "'echo ' || p_name || '~0,2 50%'")
trip("batch_machine_variables", "batch", lambda c: lit("echo %TEMP% %windir% ", c), "'echo %TEMP% C:\\Windows ' || p_name")
trip("batch_goto", "batch", lambda c: lit("set a=", c, "\ngoto end\nset a=other\n:end\necho %a%"), "'set a=' || p_name || chr(10) || 'goto end' || chr(10) || 'set a=other' || chr(10) || ':end' || chr(10) || 'echo ' || p_name")
trip("batch_for_list", "batch", lambda c: lit("for %%i in (", c, ") do echo %%i"), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: 'echo ' || w), chr(10))")
trip("batch_delayed", "batch", lambda c: lit("setlocal enabledelayedexpansion\nset a=", c, "\necho [!a!]"), "'setlocal enabledelayedexpansion' || chr(10) || 'set a=' || p_name || chr(10) || 'echo [' || p_name || ']'")
trip("batch_scope", "batch", lambda c: lit("set a=", c, "\nsetlocal\nset a=inner\nendlocal\necho %a%"), "'set a=' || p_name || chr(10) || 'setlocal' || chr(10) || 'set a=inner' || chr(10) || 'endlocal' || chr(10) || 'echo ' || p_name")
trip("batch_set_assign", "batch", lambda c: lit("set /a n=2, n+=3*4, n<<=1\necho %n% ", c), "'set /a n=2, n+=3*4, n<<=1' || chr(10) || 'echo 28 ' || p_name")
trip("batch_specials", "batch", lambda c: lit("echo ", c, " ^& ^> \"^\""), "'echo ' || p_name || ' & > \"^\"'")
trip("batch_command_line", "command", lambda c: lit("echo %zqv% ", c, " 50%%"), "'echo %zqv% ' || p_name || ' 50%%'")


def expression(name: str, made, sql: str):
    """A constant expression over part's numbers and names, evaluated."""

    def run(spark, folder):
        ship(spark)
        p = spread(table(spark, folder, "part"))
        return p.select(F.col("p_partkey").cast("long").alias("key"), L.evaluated(made(F.col("p_size").cast("string"), F.col("p_name"))).alias("value"))

    query(name, f"SELECT CAST(p_partkey AS BIGINT) AS key, CAST({sql} AS VARCHAR) AS value FROM part")(run)


expression("ps_shifts", lambda n, _: lit("(", n, " -shl 3) -shr 1"), "(p_size * 8) // 2")
expression("ps_bitwise_not", lambda n, _: lit("-bnot ", n), "-p_size - 1")
expression("ps_int_casts", lambda n, _: lit("[int]'", n, "' + [byte]3"), "p_size + 3")
expression("ps_convert_base", lambda n, _: lit("[Convert]::ToInt32('", F.hex(n.cast("long")), "', 16)"), "p_size")
expression("ps_convert_text", lambda n, _: lit("[Convert]::ToString(", n, ", 16)"), "lower(to_hex(p_size))")
expression("ps_number_forms", lambda n, _: lit("0b", F.bin(n.cast("long")), " + 0x10 + 2kb"), "p_size + 16 + 2048")
expression("ps_length", lambda _, c: lit("'", c, "'.Length"), "length(p_name)")
expression("ps_precedence", lambda n, _: lit(n, " + 2 * 3 - 10 / 5"), "p_size + 4")


# -- recipes: a line of text encoded by the standard library


def magic(name: str, encode):
    def run(spark, folder):
        ship(spark)
        text = lit(_LINE, _listed(F.col("p_name"), "-"), " now and then")
        made = F.pandas_udf(lambda s: s.map(lambda t: encode(t.encode())), "string")
        return spread(table(spark, folder, "part")).select(F.col("p_partkey").cast("long").alias("key"), L.recipe(made(text))["output"].alias("text"))

    query(name, f"SELECT CAST(p_partkey AS BIGINT) AS key, '{_LINE}' || replace(p_name, ' ', '-') || ' now and then' AS text FROM part")(run)


def _base58(raw: bytes) -> str:
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = V.BASE58_ALPHABET[d] + out
    return out


def _raw_deflate(raw: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush()


def _in_base64(pack):
    return lambda raw: base64.b64encode(pack(raw)).decode()


magic("magic_base32", lambda raw: base64.b32encode(raw).decode())
magic("magic_base58", _base58)
magic("magic_base85", lambda raw: base64.a85encode(raw).decode())
magic("magic_octal", lambda raw: " ".join(f"{b:03o}" for b in raw))
magic("magic_binary", lambda raw: " ".join(f"{b:08b}" for b in raw))
magic("magic_entities", lambda raw: "".join(f"&#{b};" for b in raw))
magic("magic_escapes", lambda raw: "".join(f"\\x{b:02x}" for b in raw))
magic("magic_quoted_printable", lambda raw: "".join(f"={b:02X}" for b in raw))
magic("magic_gzip", _in_base64(lambda raw: gzip.compress(raw, mtime=0)))
magic("magic_zlib", _in_base64(zlib.compress))
magic("magic_bzip2", _in_base64(bz2.compress))
magic("magic_lzma", _in_base64(lzma.compress))
magic("magic_raw_deflate", _in_base64(_raw_deflate))
magic("magic_utf16", _in_base64(lambda raw: raw.decode().encode("utf-16-le")))
magic("magic_xor", lambda raw: bytes(b ^ 0x5A for b in raw).hex())
magic("magic_rot47", lambda raw: "".join(chr(33 + (b - 33 + 47) % 94) if 33 <= b < 127 else chr(b) for b in raw))


# -- layers: part.p_name in a stage of another interpreter


def stage(name: str, made, language: str, edge: str, text: str = "'Write-Host \"' || p_name || '\"; $q = 1'"):
    def run(spark, folder):
        p = table(spark, folder, "part").select(F.col("p_partkey").cast("long").alias("key"), made(F.col("p_name")).alias("t"))
        return L.layers(p, "key", "t").where("depth = 1").select("key", "language", "edge", F.col("final").alias("text"))

    query(name, f"SELECT CAST(p_partkey AS BIGINT) AS key, '{language}' AS language, '{edge}' AS edge, {text} AS text FROM part")(run)


def _inner(c):
    return lit('Write-Host "', c, '"; $q = 1')


stage("layer_command", lambda c: lit("powershell -nop -Command 'Write-Host \"", c, "\"; $q = 1'"), "powershell", "HANDOFF")
stage("layer_piped", lambda c: lit("$z = 1\n'", _inner(c), "' | iex"), "powershell", "HANDOFF")
stage("layer_gcm_piped", lambda c: lit("$z = 1\n'", _inner(c), "' | & (gcm iex)"), "powershell", "HANDOFF")
stage("layer_script_block", lambda c: lit("$z = [scriptblock]::Create('", _inner(c), "')\n$env:q = 1"), "powershell", "HANDOFF")
stage("layer_js_eval", lambda c: lit("var z = 1;\nvar y = new ActiveXObject('A');\neval('var q = \"", c, "\";');"), "javascript", "HANDOFF", "'var q = \"' || p_name || '\";'")
stage("layer_vbs_execute", lambda c: lit("Dim z\nSet z = CreateObject(\"A\")\nExecute \"q = \"\"", c, "\"\"\""), "vbscript", "HANDOFF", "'q = \"' || p_name || '\"'")
stage("layer_cmd", lambda c: lit("$z = 1; $env:q = 2\ncmd /c \"echo ", c, "\""), "batch", "HANDOFF", "'echo ' || p_name")
stage("layer_mshta", lambda c: lit("@echo off\nset z=1\nmshta vbscript:q=1+", F.replace(c, F.lit(" "), F.lit("_"))), "vbscript", "HANDOFF", "'q=1+' || replace(p_name, ' ', '_')")


def _packed(c):
    return F.pandas_udf(lambda s: s.map(lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode()), "string")(c)


stage("layer_base64", lambda c: lit("$z = 1\n$d = '", _b64(F.encode(lit("$env:p = 1; ", _inner(c)), "UTF-8")), "'"), "powershell", "DECODE", "'$env:p = 1; Write-Host \"' || p_name || '\"; $q = 1'")
stage("layer_compressed", lambda c: lit("$z = 1\n$d = '", _packed(lit("$env:p = 1; ", _inner(c))), "'"), "powershell", "DECOMPRESS", "'$env:p = 1; Write-Host \"' || p_name || '\"; $q = 1'")


# -- indicators beyond the common patterns: one text for each customer, every family in it



def _k():
    return F.col("c_custkey").cast("string")


_FAMILIES = {
    # family: (what stands in the text, the value in SQL)
    "ip": (lambda k: lit("see 2001:db8::", F.lower(F.hex(F.col("c_custkey"))), " now"), "'2001:db8::' || lower(to_hex(c_custkey))"),
    "ipv6_port": (lambda k: lit("at [fd00::", F.lower(F.hex(F.col("c_custkey"))), "]:8443 too"), "'[fd00::' || lower(to_hex(c_custkey)) || ']:8443'"),
    "user_agent": (lambda k: lit("agent \"Mozilla/5.0 (X11) k", k, "\""), "'Mozilla/5.0 (X11) k' || c_custkey"),
    "crypto_wallet": (lambda k: lit("pay 0x", F.lpad(F.lower(F.hex(F.col("c_custkey"))), 40, "0"), " soon"), "'0x' || lpad(lower(to_hex(c_custkey)), 40, '0')"),
    "file_path": (lambda k: lit("run \"C:\\data\\f", k, ".exe\" once"), "'C:\\data\\f' || c_custkey || '.exe'"),
    "unc_path": (lambda k: lit("from \\\\srv", k, "\\share\\x.dat here"), "'\\\\srv' || c_custkey || '\\share\\x.dat'"),
    "scheduled_task": (lambda k: lit("schtasks /create /tn \"job", k, "\" ok"), "'job' || c_custkey"),
    "service_name": (lambda k: lit("sc create svc", k, " binpath"), "'svc' || c_custkey"),
    "mutex": (lambda k: lit("held Global\\mtx", k, " yet"), "'Global\\mtx' || c_custkey"),
}


def _scan_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT c_custkey, '{kind}' AS type, {value} AS value FROM customer" for kind, (_, value) in _FAMILIES.items())
    # An address and port give the address as well.
    rows += " UNION ALL SELECT c_custkey, 'ip', 'fd00::' || lower(to_hex(c_custkey)) FROM customer"
    return f"SELECT CAST(c_custkey AS BIGINT) AS key, type, value FROM ({rows})"


@query("scan_generated", _scan_sql())
def scan_generated(spark, folder):
    c = table(spark, folder, "customer")
    text = F.concat_ws("\n", *(made(_k()) for made, _ in _FAMILIES.values()))
    found = findings.scan(c.select(F.col("c_custkey").cast("long").alias("key"), text.alias("t")), "key", "t", rules=False)
    return found.where(F.col("type").isin(*_FAMILIES)).select("key", "type", "value")


@query("residual_blobs_generated", "SELECT CAST(c_custkey AS BIGINT) AS key, 'base64_blob' AS type, replace(to_base64(unhex(sha256('a' || c_custkey) || sha256('b' || c_custkey) || substr(sha256('c' || c_custkey), 1, 4))), chr(10), '') AS value FROM customer")
def residual_blobs_generated(spark, folder):
    c = table(spark, folder, "customer")
    raw = F.unhex(F.concat(F.sha2(lit("a", _k()), 256), F.sha2(lit("b", _k()), 256), F.substr(F.sha2(lit("c", _k()), 256), F.lit(1), F.lit(4))))
    return S.residual_base64(c.select(F.col("c_custkey").cast("long").alias("key"), lit("$d = ", _b64(raw), " end").alias("t")), "key", "t")


# -- written cases

_CHECKS = {
    # test: (function, [(text, whether it holds)])
    "ipv6": (checks.ipv6, [("::1", True), ("::", False), ("fe80::1", True), ("::dead", False), ("dead::beef", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7:8:9", False), ("12345::", False), ("::ffff:192.0.2.1", True), ("", False)]),
    "base58check": (checks.base58check, [("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", True), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", False), ("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", True), ("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN0", False), ("", False)]),
    "bech32": (checks.bech32, [("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", True), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", False), ("a12uel5l", True), ("a12uel5m", False), ("1pzry9x0s0muk", False), ("", False)]),
    "artefact": (lambda t: checks.artefact(t) is not None, [("Updater", True), ("-Force", False), ("/create", False), ("$name", False), ("(Get-Date)", False), ("---", False), ("", False), ("a" * 120, True), ("a" * 121, False)]),
}


@query("validator_cases", "SELECT * FROM (VALUES " + ", ".join(f"({_q(n)}, {i}, {str(ok).lower()})" for n, (_, cases) in _CHECKS.items() for i, (_, ok) in enumerate(cases)) + ") AS t(test, number, holds)")
def validator_cases(spark, folder):
    ship(spark)
    rows = spark.createDataFrame([(n, i, t) for n, (_, cases) in _CHECKS.items() for i, (t, _) in enumerate(cases)], "test string, number int, text string")
    tests = {n: f for n, (f, _) in _CHECKS.items()}
    holds = F.pandas_udf(lambda names, texts: (names + "\n" + texts).map(lambda x: bool(tests[x.split("\n")[0]](x.split("\n", 1)[1]))), "boolean")
    return rows.select("test", "number", holds("test", "text").alias("holds"))


def _vt(m, s, h, u):
    return f'{{"data": {{"attributes": {{"last_analysis_stats": {{"malicious": {m}, "suspicious": {s}, "harmless": {h}, "undetected": {u}}}}}}}}}'


_ANSWERS = [
    # provider, type asked about, stored answer, verdict: each provider's thresholds at their edges
    ("virustotal", "ip", _vt(1, 0, 60, 0), "malicious"), ("virustotal", "ip", _vt(0, 1, 60, 0), "suspicious"), ("virustotal", "ip", _vt(0, 0, 1, 0), "clean"), ("virustotal", "ip", _vt(0, 0, 0, 1), "clean"), ("virustotal", "ip", _vt(0, 0, 0, 0), "unknown"),
    ("abuseipdb", "ip", '{"data": {"abuseConfidenceScore": 75, "totalReports": 3}}', "malicious"), ("abuseipdb", "ip", '{"data": {"abuseConfidenceScore": 74, "totalReports": 3}}', "suspicious"), ("abuseipdb", "ip", '{"data": {"abuseConfidenceScore": 25}}', "suspicious"),
    ("abuseipdb", "ip", '{"data": {"abuseConfidenceScore": 24, "totalReports": 1}}', "clean"), ("abuseipdb", "ip", '{"data": {"abuseConfidenceScore": 0, "totalReports": 0}}', "unknown"),
    ("otx", "domain", '{"pulse_info": {"count": 3}}', "malicious"), ("otx", "domain", '{"pulse_info": {"count": 2}}', "suspicious"), ("otx", "domain", '{"pulse_info": {"count": 1}}', "suspicious"), ("otx", "domain", '{"pulse_info": {"count": 0}}', "unknown"),
    ("greynoise", "ip", '{"classification": "malicious"}', "malicious"), ("greynoise", "ip", '{"classification": "Benign"}', "clean"), ("greynoise", "ip", '{"classification": "suspicious"}', "suspicious"), ("greynoise", "ip", "{}", "unknown"),
    ("pulsedive", "domain", '{"risk": "critical"}', "malicious"), ("pulsedive", "domain", '{"risk": "high"}', "malicious"), ("pulsedive", "domain", '{"risk": "medium"}', "suspicious"), ("pulsedive", "domain", '{"risk": "low"}', "clean"), ("pulsedive", "domain", '{"risk": "none"}', "clean"), ("pulsedive", "domain", '{"risk": "unknown"}', "unknown"),
    ("shodan", "ip", '{"tags": ["c2"], "ports": [80]}', "suspicious"), ("shodan", "ip", '{"vulns": ["CVE-2020-1"], "ports": []}', "suspicious"), ("shodan", "ip", '{"ports": [80]}', "clean"), ("shodan", "ip", "{}", "unknown"),
    ("abusech", "hash_sha256", '{"query_status": "ok", "data": [{"signature": "x"}]}', "malicious"), ("abusech", "hash_sha256", '{"query_status": "ok", "data": []}', "unknown"), ("abusech", "hash_md5", '{"query_status": "hash_not_found"}', "unknown"), ("abusech", "hash_sha1", '{"query_status": "illegal_hash"}', "error"),
    ("abusech", "signature", '{"query_status": "no_results"}', "unknown"), ("abusech", "signature", '{"query_status": "signature_not_found"}', "unknown"), ("abusech", "signature", '{"query_status": "ok", "data": [{}]}', "malicious"), ("abusech", "url", '{"query_status": "ok"}', "malicious"), ("abusech", "url", '{"query_status": "no_results"}', "unknown"),
    ("abusech", "email", '{"query_status": "ok"}', "not_checked"), ("nobody", "ip", "{}", "unknown"), ("virustotal", "ip", "no json", "unknown"),
]


@query("provider_verdicts", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(v)})" for i, (*_, v) in enumerate(_ANSWERS)) + ") AS t(number, verdict)")
def provider_verdicts(spark, folder):
    rows = spark.createDataFrame([(i, p, t, b) for i, (p, t, b, _) in enumerate(_ANSWERS)], "number int, provider string, type string, body string")
    return rows.select("number", enrich.provider_verdict(F.col("provider"), F.col("body"), F.col("type")).alias("verdict"))


_LOOKUPS = [
    ("192.0.2.1", "auto", "ip"), ("hxxp://a[.]test/x", "", "url"), ("a.example", "auto", "domain"), ("a.nosuchlabel", "auto", None), ("0" * 32, "hash", "hash_md5"), ("0" * 40, "hash", "hash_sha1"), ("0" * 64, "hash", "hash_sha256"), ("0" * 33, "hash", None),
    ("x", "signature", "signature"), (" ", "auto", None), ("b.test", "domain", "domain"), ("b.test", "nonsense", None),
]


@query("lookup_types", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, (*_, t) in enumerate(_LOOKUPS)) + ") AS t(number, type)")
def lookup_types(spark, folder):
    rows = spark.createDataFrame([(i, v, r) for i, (v, r, _) in enumerate(_LOOKUPS)], "number int, value string, requested string")
    return rows.select("number", enrich.resolve_type(F.col("value"), F.col("requested")).alias("type"))


_LANGUAGES = [
    ("$a = 1\nWrite-Host $a\n$b = $env:TEMP", "powershell"), ("@echo off\nset a=1\necho %a%", "batch"), ("var a = 1;\nconsole.log(a);\nfunction f(x) { return x; }", "javascript"), ("Dim a\nSet a = CreateObject(\"X\")\nEnd Sub", "vbscript"),
    ("<hta:application id=x>", "hta"), ("<job id=\"a\"><script/></job>", "wsf"), ("plain words and nothing else", "text"), ("", "text"), (" " * 300_000 + "@echo off\nset a=1", "batch"), ("x" * 250_000 + "\n@echo off\nset a=1\n" + "y" * 250_000, "batch"),
]


@query("language_cases", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(x)})" for i, (_, x) in enumerate(_LANGUAGES)) + ") AS t(number, language)")
def language_cases(spark, folder):
    ship(spark)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_LANGUAGES)], "number int, text string")
    return rows.select("number", L.language_of(F.col("text")).alias("language"))


# -- what reports are made of

_SEVERITY_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in V.SEVERITIES)
_CHEF = "recipe=%5B%7B%22op%22%3A%22Magic%22%2C%22args%22%3A%5B4%2Ctrue%2Cfalse%2C%22%22%5D%7D%5D"
_ABLE = ", ".join(sorted({f"'{t}'" for types in V.CAPABILITY.values() for t in types}))


@query("html_escaped", "SELECT id, replace(replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS value FROM findings")
def html_escaped(spark, folder):
    return table(spark, folder, "findings").select("id", reports.html_escaped(F.col("value")).alias("value"))


@query("capped_texts", "SELECT id, left(original_text, 500) AS original_text, coalesce(length(original_text) > 500, false) AS truncated FROM analyses")
def capped_texts(spark, folder):
    return reports.capped(table(spark, folder, "analyses").select("id", "original_text"), "original_text", 500)


@query("batch_totals", f"SELECT batch_id, count(DISTINCT analysis_id) AS analyses, count(*) AS findings, {_SEVERITY_COUNTS} FROM findings f JOIN analyses a ON a.id = f.analysis_id WHERE batch_id IS NOT NULL GROUP BY batch_id")
def batch_totals(spark, folder):
    members = table(spark, folder, "analyses").where("batch_id IS NOT NULL").select(F.col("id").alias("analysis_id"), "batch_id")
    return reports.report_totals(table(spark, folder, "findings").join(members, "analysis_id"), ["batch_id"])


@query("asked_counts", f"SELECT analysis_id, count(*) AS findings, count(*) FILTER (type IN ({_ABLE})) AS queried, count(DISTINCT value) FILTER (type = 'ip') AS located FROM findings GROUP BY analysis_id")
def asked_counts(spark, folder):
    return reports.asked_counts(table(spark, folder, "findings"))


@query("addresses_in_order", "WITH f AS (SELECT analysis_id, value, min(id) AS first FROM findings WHERE type = 'ip' AND value IS NOT NULL GROUP BY ALL) SELECT analysis_id, value, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY first, value) AS INTEGER) AS place FROM f")
def addresses_in_order(spark, folder):
    return reports.addresses(table(spark, folder, "findings"))


@query("chef_links", f"SELECT id, CASE WHEN octet_length(encode(value)) BETWEEN 1 AND 200000 THEN '{_CHEF}&input=' || replace(replace(replace(to_base64(encode(value)), '+', '%2B'), '/', '%2F'), '=', '%3D') ELSE '{_CHEF}' END AS link FROM findings")
def chef_links(spark, folder):
    return table(spark, folder, "findings").select("id", reports.chef_link(F.col("value")).alias("link"))


@query("intel_details", "SELECT finding_id, count(*) AS answers, left(string_agg(detail, ', ' ORDER BY detail) FILTER (detail <> ''), 320) AS detail FROM finding_intel GROUP BY finding_id")
def intel_details(spark, folder):
    held = table(spark, folder, "finding_intel").groupBy("finding_id").agg(F.count(F.lit(1)).alias("answers"), F.array_sort(F.collect_list(F.when(F.col("detail") != "", F.col("detail")))).alias("d"))
    return held.select("finding_id", "answers", F.when(F.size("d") > 0, F.left(F.array_join("d", ", "), F.lit(320))).alias("detail"))


@query("provider_order", "WITH e AS (SELECT DISTINCT finding_id, coalesce(lower(trim(verdict)) = 'not_checked', false) AS last, source FROM finding_intel WHERE source IS NOT NULL) SELECT finding_id, string_agg(source, ',' ORDER BY last, source) AS sources FROM e GROUP BY finding_id")
def provider_order(spark, folder):
    return reports.provider_order(table(spark, folder, "finding_intel")).select("finding_id", F.array_join("sources", ",").alias("sources"))


@query("settings_upserted", "SELECT source AS key, arg_max(verdict, (fetched_at, verdict)) AS value FROM intel_cache WHERE fetched_at IS NOT NULL AND verdict IS NOT NULL GROUP BY source")
def settings_upserted(spark, folder):
    """Every source's newest verdict, put over its oldest."""
    c = table(spark, folder, "intel_cache").where("fetched_at IS NOT NULL AND verdict IS NOT NULL").groupBy(F.col("source").alias("key"))
    at = F.struct("fetched_at", "verdict")
    return reports.upserted(c.agg(F.min_by("verdict", at).alias("value")), c.agg(F.max_by("verdict", at).alias("value")))
