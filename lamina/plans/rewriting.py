"""Queries of the rewriting half. Most are round trips: a column is obfuscated in the query, our operator has to give it back, and the SQL just selects the column."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import layers as L
from lamina.operators import surveys as S
from lamina.session import ship, spread, table
from lamina.functions import text as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def trip(name: str, source: str, key: str, column: str, made, language: str, shown, where: str = "true"):
    """A round trip over a whole table: made(column) is the obfuscated text; shown(column) in SQL is what must come out."""

    def run(spark, folder):
        ship(spark)
        df = spread(table(spark, folder, source).where(where))
        return df.select(F.col(key).cast("long").alias("key"), L.rewritten(made(F.col(column)), F.lit(language)).alias("text"))

    query(name, f"SELECT CAST({key} AS BIGINT) AS key, {shown} AS text FROM {source} WHERE {where}")(run)


def _codes(c, sep=","):
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("string")), sep)


def _b64(c):
    """Base64 on one line; Spark's own breaks lines."""
    return F.regexp_replace(F.base64(c), "[\r\n]", "")


_HALF = lambda c: (F.substr(c, F.lit(1), F.floor(F.length(c) / 2).cast("int")), F.substr(c, (F.floor(F.length(c) / 2) + 1).cast("int")))
_PART = ("part", "p_partkey", "p_name")

trip("ps_concat", *_PART, lambda c: F.concat(F.lit("$x = '"), _HALF(c)[0], F.lit("' + '"), _HALF(c)[1], F.lit("'")), "powershell", "'$x = ''' || p_name || ''''")
trip("ps_char_codes", *_PART, lambda c: F.concat(F.lit("$x = -join [char[]]("), _codes(c), F.lit(")")), "powershell", "'$x = ''' || p_name || ''''")
trip("ps_reverse_index", *_PART, lambda c: F.concat(F.lit("$x = '"), F.reverse(c), F.lit("'[-1..-"), F.length(c).cast("string"), F.lit("] -join ''")), "powershell", "'$x = ''' || p_name || ''''")
trip("ps_format", *_PART, lambda c: F.concat(F.lit("$x = '{1}{0}' -f '"), _HALF(c)[1], F.lit("','"), _HALF(c)[0], F.lit("'")), "powershell", "'$x = ''' || p_name || ''''")
trip("ps_join", *_PART, lambda c: F.concat(F.lit("$x = ('"), F.replace(c, F.lit(" "), F.lit("','")), F.lit("' -join ' ')")), "powershell", "'$x = ''' || p_name || ''''")
trip("ps_replace", *_PART, lambda c: F.concat(F.lit("$x = '"), F.replace(c, F.lit("e"), F.lit("#!")), F.lit("'.Replace('#!','e')")), "powershell", "'$x = ''' || p_name || ''''", "contains(p_name, 'e')")
trip("ps_base64", *_PART, lambda c: F.concat(F.lit("$x = [Text.Encoding]::UTF8.GetString([Convert]::FromBase64String('"), _b64(F.encode(c, "UTF-8")), F.lit("'))")), "powershell", "'$x = ''' || p_name || ''''")
trip("ps_percent", *_PART, lambda c: F.concat(F.lit("$x = [Uri]::UnescapeDataString('"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("')")), "powershell", "'$x = ''' || p_name || ''''")
trip("ps_backticks", *_PART, lambda c: F.concat(F.lit("W`rite-H`ost '"), c, F.lit("'")), "powershell", "'Write-Host ''' || p_name || ''''")
trip("ps_nested", *_PART, lambda c: F.concat(F.lit("$x = [Text.Encoding]::Unicode.GetString([Convert]::FromBase64String('"), _b64(F.encode(c, "UTF-16LE")), F.lit("')).ToUpper() + ('!' * 2)")), "powershell", "'$x = ''' || upper(p_name) || '!!'''")
trip("js_char_codes", *_PART, lambda c: F.concat(F.lit("var x = String.fromCharCode("), _codes(c), F.lit(");")), "javascript", "'var x = ''' || p_name || ''';'")
trip("js_concat", *_PART, lambda c: F.concat(F.lit("var x = '"), _HALF(c)[0], F.lit("' + '"), _HALF(c)[1], F.lit("';")), "javascript", "'var x = ''' || p_name || ''';'")
trip("js_reverse", *_PART, lambda c: F.concat(F.lit("var x = '"), F.reverse(c), F.lit("'.split('').reverse().join('');")), "javascript", "'var x = ''' || p_name || ''';'")
trip("js_unescape", *_PART, lambda c: F.concat(F.lit("var x = unescape('"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("');")), "javascript", "'var x = ''' || p_name || ''';'")
trip("js_atob", *_PART, lambda c: F.concat(F.lit("var x = atob('"), _b64(F.encode(c, "UTF-8")), F.lit("');")), "javascript", "'var x = ''' || p_name || ''';'")
trip("vbs_chr", *_PART, lambda c: F.concat(F.lit("x = "), F.array_join(F.transform(F.split(c, ""), lambda x: F.concat(F.lit("Chr("), F.ascii(x).cast("string"), F.lit(")"))), " & ")), "vbscript", "'x = \"' || p_name || '\"'")
trip("vbs_concat", *_PART, lambda c: F.concat(F.lit('x = "'), _HALF(c)[0], F.lit('" & "'), _HALF(c)[1], F.lit('"')), "vbscript", "'x = \"' || p_name || '\"'")
trip("vbs_reverse", *_PART, lambda c: F.concat(F.lit('x = StrReverse("'), F.reverse(c), F.lit('")')), "vbscript", "'x = \"' || p_name || '\"'")
trip("vbs_mid", *_PART, lambda c: F.concat(F.lit('x = Mid("zz'), c, F.lit('zz", 3, '), F.length(c).cast("string"), F.lit(")")), "vbscript", "'x = \"' || p_name || '\"'")
trip("batch_carets", "customer", "c_custkey", "c_name", lambda c: F.concat(F.lit("e^ch^o "), c), "batch", "'echo ' || c_name")
trip("batch_substring", "customer", "c_custkey", "c_name", lambda c: F.concat(F.lit("set a=zz"), c, F.lit("\necho %a:~2%")), "batch", "'set a=zz' || c_name || chr(10) || 'echo ' || c_name")
trip("batch_replace", "customer", "c_custkey", "c_name", lambda c: F.concat(F.lit("set a="), F.replace(c, F.lit("u"), F.lit("_Q_")), F.lit("\necho %a:_Q_=u%")), "batch", "'set a=' || replace(c_name, 'u', '_Q_') || chr(10) || 'echo ' || c_name")


def _arith(name, expression, sql):
    def run(spark, folder):
        ship(spark)
        df = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("long").alias("a"), F.col("l_suppkey").cast("long").alias("b"))
        return df.groupBy("o", "n", "a", "b").agg(F.count(F.lit(1)).alias("k")).select("o", "n", "a", "b", "k", L.evaluated(expression(F.col("a").cast("string"), F.col("b").cast("string"))).alias("value"))

    query(name, f"SELECT o, n, a, b, k, CAST({sql} AS VARCHAR) AS value FROM (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_partkey AS BIGINT) AS a, CAST(l_suppkey AS BIGINT) AS b, count(*) AS k FROM lineitem GROUP BY ALL)")(run)


_arith("ps_arithmetic", lambda a, b: F.concat(a, F.lit(" * 3 + "), b, F.lit(" - (7 - "), a, F.lit(")")), "a * 3 + b - (7 - a)")
_arith("ps_remainder", lambda a, b: F.concat(F.lit("(-"), a, F.lit(") % ("), b, F.lit(" + 1)")), "(-a) % (b + 1)")
_arith("ps_bits", lambda a, b: F.concat(F.lit("("), a, F.lit(" -bxor "), b, F.lit(") -band 255")), "xor(a, b) & 255")


@query("batch_set_a", "SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(((o_orderkey * 65537 + o_custkey * 3) + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS value FROM orders")
def batch_set_a(spark, folder):
    ship(spark)
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("key"), L.cmd_value(F.concat(F.col("o_orderkey").cast("string"), F.lit(" * 65537 + "), F.col("o_custkey").cast("string"), F.lit("*3"))).alias("value"))


_LINE = "powershell start http://a.test/"


def _magic(name, made):
    def run(spark, folder):
        ship(spark)
        df = spread(table(spark, folder, "part")).withColumn("t", F.concat(F.lit(_LINE), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" now and then")))
        return df.select(F.col("p_partkey").cast("long").alias("key"), L.recipe(made(F.col("t")))["output"].alias("text"))

    query(name, f"SELECT CAST(p_partkey AS BIGINT) AS key, '{_LINE}' || replace(p_name, ' ', '-') || ' now and then' AS text FROM part")(run)


_magic("magic_base64", lambda t: _b64(F.encode(t, "UTF-8")))
_magic("magic_hex", lambda t: F.lower(F.hex(F.encode(t, "UTF-8"))))
_magic("magic_decimal", lambda t: _codes(t, " "))
_magic("magic_url", lambda t: F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1"))
_magic("magic_reverse", lambda t: F.reverse(t))
_magic("magic_twice", lambda t: _b64(F.encode(_b64(F.encode(t, "UTF-8")), "UTF-8")))
_magic("magic_rot13", lambda t: F.translate(t, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"))


def _nested(spark, folder):
    """Two stages in one line: an encoded command that hands a literal on."""
    p = table(spark, folder, "part")
    inner = F.concat(F.lit("iex 'Write-Host \""), F.col("p_name"), F.lit("\"; $q = 1'"))
    return p.select(F.col("p_partkey").cast("long").alias("key"), F.concat(F.lit("powershell -nop -enc "), _b64(F.encode(inner, "UTF-16LE"))).alias("t"))


@query("layer_texts", "SELECT CAST(p_partkey AS BIGINT) AS key, '1/2/3' AS path, 2 AS depth, 'Write-Host \"' || p_name || '\"; $q = 1' AS text FROM part")
def layer_texts(spark, folder):
    return L.layers(_nested(spark, folder), "key", "t").where("depth = 2").select("key", "path", "depth", F.col("final").alias("text"))


@query("layer_trees", "SELECT CAST(p_partkey AS BIGINT) AS key, CAST(3 AS BIGINT) AS layers, 2 AS depth, true AS converged FROM part")
def layer_trees(spark, folder):
    return L.tree(L.layers(_nested(spark, folder), "key", "t"), "key").select("key", "layers", "depth", "converged")


@query("layer_attribution", "SELECT CAST(c_custkey AS BIGINT) AS key, 'http://h' || c_custkey || '.test/x' AS value, '1/2' AS path FROM customer")
def layer_attribution(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.concat(F.lit("$n = 1\nIEX 'Invoke-WebRequest http://h"), F.col("c_custkey").cast("string"), F.lit(".test/x'")).alias("t"))
    c = c.withColumn("t", F.concat(F.lit("powershell -enc "), _b64(F.encode(F.concat(F.lit("Invoke-WebRequest http://h"), F.col("key").cast("string"), F.lit(".test/x")), "UTF-16LE"))))
    return L.layer_findings(L.layers(c, "key", "t"), "key").where("type = 'url'").select("key", "value", "path")


@query("layers_of_analyses")
def layers_of_analyses(spark, folder):
    return L.layers(table(spark, folder, "analyses"), "id", "original_text").select("id", "layer_id", "path", "depth", "language", "edge", "sha256", "rounds", "converged", F.length("final").alias("size"), F.size("rules").alias("changes"))


@query("rewritten_analyses")
def rewritten_analyses(spark, folder):
    ship(spark)
    return spread(table(spark, folder, "analyses")).select("id", L.rewritten(F.col("original_text")).alias("text"))


@query("languages_of_analyses")
def languages_of_analyses(spark, folder):
    ship(spark)
    return spread(table(spark, folder, "analyses").select("id", "original_text")).select("id", L.language_of(F.col("original_text")).alias("language"))


@query("url_decode_plus", "SELECT CAST(p_partkey AS BIGINT) AS key, p_name AS text FROM part")
def url_decode_plus(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").cast("long").alias("key"), T.percent_decode(F.url_encode("p_name"), True).alias("text"))


@query("url_decode_data", "SELECT CAST(p_partkey AS BIGINT) AS key, replace(p_name, ' ', '+') AS text FROM part")
def url_decode_data(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").cast("long").alias("key"), T.percent_decode(F.url_encode("p_name"), False).alias("text"))


@query("residual_runs")
def residual_runs(spark, folder):
    return S.residual_runs(table(spark, folder, "documents"), "doc_id", "text")


@query("residual_base64")
def residual_base64(spark, folder):
    return S.residual_base64(table(spark, folder, "documents"), "doc_id", "text")


@query("encoded_runs")
def encoded_runs(spark, folder):
    return S.encoded_runs(table(spark, folder, "analyses"), "id", "original_text").select("id", "run", F.array_join("steps", " > ").alias("steps"), "output")


@query("indicator_spans")
def indicator_spans(spark, folder):
    return S.indicator_spans(table(spark, folder, "documents"), "doc_id", "text")


@query("statements_of_analyses")
def statements_of_analyses(spark, folder):
    return S.statements(table(spark, folder, "analyses"), "id", "deobfuscated_text")


@query("defanged_documents")
def defanged_documents(spark, folder):
    ship(spark)
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", S.defanged_text(F.col("text")).alias("text"))


@query("rule_explanations")
def rule_explanations(spark, folder):
    changed = L.layers(table(spark, folder, "analyses"), "id", "original_text").select(F.explode("rules").alias("rule"))
    return changed.groupBy("rule").agg(F.count(F.lit(1)).alias("changes")).select("rule", S.explained(F.col("rule")).alias("explained"), "changes")


_BARE = "CASE WHEN g = 'ip' AND length(value) - length(replace(value, ':', '')) = 1 THEN split_part(value, ':', 1) ELSE value END"


def _link_sql(provider: str) -> str:
    pages = {g: u for (p, g), u in S.PAGES.items() if p == provider}
    parts = " ".join(f"WHEN '{g}' THEN '{u}' || " + ("form" if "?" in u else "path") + (" || '/'" if (provider, g) == ("abusech", "signature") else "") for g, u in pages.items())
    return f"CASE WHEN value = '' THEN NULL ELSE CASE g {parts} END END AS {provider}"


_PROVIDERS = list(dict.fromkeys(p for p, _ in S.PAGES))


@query("provider_links", "WITH g AS (SELECT id, value, CASE WHEN type IN ('ip', 'ip_port') THEN 'ip' WHEN type IN ('hash_md5', 'hash_sha1', 'hash_sha256') THEN 'hash' WHEN type IN ('domain', 'url', 'signature') THEN type END AS g FROM findings), b AS (SELECT *, " + _BARE + " AS bare FROM g), f AS (SELECT *, url_encode(bare) AS path, replace(url_encode(bare), '%20', '+') AS form FROM b) SELECT id, " + ", ".join(map(_link_sql, _PROVIDERS)) + " FROM f")
def provider_links(spark, folder):
    f = table(spark, folder, "findings")
    return f.select("id", *(S.provider_link(F.lit(p), F.col("type"), F.col("value")).alias(p) for p in _PROVIDERS))


@query("layer_findings_of_analyses")
def layer_findings_of_analyses(spark, folder):
    found = L.layers(table(spark, folder, "analyses"), "id", "original_text")
    return L.layer_findings(found, "id")


@query("layer_texts_of_analyses")
def layer_texts_of_analyses(spark, folder):
    return L.rendered(L.layers(table(spark, folder, "analyses"), "id", "original_text"), "id")


@query("batch_for_l", "SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(i - o_custkey % 100 AS INTEGER) AS at, 'echo ' || i AS command FROM (SELECT o_orderkey, o_custkey, unnest(range(o_custkey % 100, o_custkey % 100 + 5)) AS i FROM orders)")
def batch_for_l(spark, folder):
    ship(spark)
    start = F.col("o_custkey") % 100
    line = F.concat(F.lit("for /l %i in ("), start.cast("string"), F.lit(",1,"), (start + 4).cast("string"), F.lit(") do echo %i"))
    return table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("key"), F.posexplode(L.loop_commands(line)).alias("at", "command"))
