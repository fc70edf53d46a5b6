"""Surveys of texts beyond findings: what stays encoded, where indicators stand, links and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import ship, spread


def _exploded(df: DataFrame, key: str, text: str, function, schema: str) -> DataFrame:
    """(key, fields) of a kernel function that gives tuples; texts that a cheap length test rules out never reach Python."""
    ship(df.sparkSession)
    names = [f.split(":")[0] for f in schema.split(",")]
    run = F.pandas_udf(lambda part: part.map(lambda t: [dict(zip(names, x)) for x in function(t)]), f"array<struct<{schema}>>")
    return spread(df.select(key, text)).where(F.length(text) > 0).select(key, F.explode(run(F.col(text))).alias("r")).select(key, "r.*")


def residual_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, size, entropy, reason) of encoded runs that nothing opens."""

    def run(t):
        from lamina.kernel.inspect import residual

        return residual(t)

    return _exploded(df.where(F.length(text) >= 40), key, text, run, "start:int,size:int,entropy:double,reason:string")


def residual_base64(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, type, value): Base64 runs that survived, as findings of type base64_blob."""

    def run(t):
        from lamina.kernel.inspect import residual_blobs

        return [(b,) for b in residual_blobs(t)]

    worth = df.where(F.col(text).rlike("[A-Za-z0-9+/]{64}"))
    return _exploded(worth, key, text, run, "value:string").select(key, F.lit("base64_blob").alias("type"), "value")


def encoded_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run, steps, output) of a text's candidate runs; steps and output where a recipe reads them."""

    def run(t):
        from lamina.kernel.decoders import candidates, search

        found = [(c, search(c)) for c in candidates(t)]
        return [(c, list(r.steps) if r else None, r.output.encode("utf-8", "replace").decode() if r else None) for c, r in found]

    return _exploded(df.where(F.length(text) >= 16), key, text, run, "run:string,steps:array<string>,output:string")


def indicator_spans(df: DataFrame, key: str, text: str, radius: int = 40) -> DataFrame:
    """(key, start, end, type, value, context) of indicators that don't overlap, the more specific first; start counts from 0."""

    def run(t):
        from lamina.kernel.inspect import spans

        return [(a, b, k, t[a:b], t[max(0, a - radius) : b + radius].replace("\n", " ").strip()) for a, b, k in spans(t)]

    return _exploded(df, key, text, run, "start:int,end:int,type:string,value:string,context:string")


def statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, statement): the top-level statements of PowerShell texts, in their order."""

    def run(t):
        from lamina.kernel.inspect import statements as cut

        return list(enumerate(cut(t)))

    return _exploded(df, key, text, run, "number:int,statement:string")


def revealed_strings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value): interpolated strings that can be read."""

    def run(t):
        from lamina.kernel.inspect import revealed
        from lamina.kernel.rewrite import assigned

        return [(v,) for v in revealed(t, assigned(t))]

    return _exploded(df.where(F.col(text).contains("$")), key, text, run, "value:string")


def defanged_text(text: Column) -> Column:
    def run(texts):
        from lamina.kernel.inspect import defanged

        return texts.map(defanged, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def masked_text(text: Column) -> Column:
    def run(texts):
        from lamina.kernel.inspect import masked

        return texts.map(masked, na_action="ignore")

    # Only a text with a quote before an operation has anything to mask.
    return F.when(text.rlike(r"(?i)['\"]\s*(?:\.\s*(?:insert|remove|replace|substring|trim|pad)|-[ci]?replace)"), F.pandas_udf(run, "string")(text)).otherwise(text)


# The pages on which providers show a value, by provider and kind of value.
PAGES = {
    ("virustotal", "ip"): "https://www.virustotal.com/gui/ip-address/", ("virustotal", "domain"): "https://www.virustotal.com/gui/domain/", ("virustotal", "hash"): "https://www.virustotal.com/gui/file/",
    ("virustotal", "url"): "https://www.virustotal.com/gui/search/", ("virustotal", "signature"): "https://www.virustotal.com/gui/search/", ("abusech", "hash"): "https://bazaar.abuse.ch/browse.php?search=",
    ("abusech", "signature"): "https://bazaar.abuse.ch/browse/signature/", ("abusech", "url"): "https://urlhaus.abuse.ch/browse.php?search=", ("abusech", "ip"): "https://threatfox.abuse.ch/browse.php?search=ioc%3A",
    ("abusech", "domain"): "https://threatfox.abuse.ch/browse.php?search=ioc%3A", ("otx", "ip"): "https://otx.alienvault.com/indicator/ip/", ("otx", "domain"): "https://otx.alienvault.com/indicator/domain/",
    ("otx", "hash"): "https://otx.alienvault.com/indicator/file/", ("otx", "url"): "https://otx.alienvault.com/indicator/url/", ("abuseipdb", "ip"): "https://www.abuseipdb.com/check/", ("shodan", "ip"): "https://www.shodan.io/host/",
    ("greynoise", "ip"): "https://viz.greynoise.io/ip/", ("pulsedive", "ip"): "https://pulsedive.com/indicator/?ioc=", ("pulsedive", "domain"): "https://pulsedive.com/indicator/?ioc=",
    ("pulsedive", "hash"): "https://pulsedive.com/indicator/?ioc=", ("pulsedive", "url"): "https://pulsedive.com/indicator/?ioc=",
}


def provider_link(provider: Column, kind: Column, value: Column) -> Column:
    """The provider's page for a finding, or null where it has none. Digests have pages under their own type names."""
    group = F.when(kind.isin("ip", "ip_port"), "ip").when(kind.isin("hash_md5", "hash_sha1", "hash_sha256"), "hash").when(kind.isin("domain", "url", "signature"), kind)
    bare = F.when((group == "ip") & (F.length(value) - F.length(F.replace(value, F.lit(":"), F.lit(""))) == 1), F.substring_index(value, ":", 1)).otherwise(value)
    page = F.coalesce(*(F.when((provider == p) & (group == g), F.lit(u)) for (p, g), u in PAGES.items()))
    # The encoder is one for forms: in a path a blank is %20, and everywhere an asterisk is %2A and a tilde stays.
    form = F.replace(F.replace(F.url_encode(bare), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    shown = F.when(page.contains("?"), form).otherwise(F.replace(form, F.lit("+"), F.lit("%20")))
    return F.when(value != "", F.concat(page, shown, F.when((provider == "abusech") & (group == "signature"), "/").otherwise("")))


# What a kind of change is, for readers of a report.
EXPLANATIONS = {
    "fold": "A constant expression was computed and its text put in its place.", "backticks": "Backticks that only break up a word were removed.", "quotes": "Typographic quotes and dashes were made plain.", "calls": "A command called by its name in quotes is shown by the name.",
    "aliases": "A short name of a command was written out.", "stock": "A variable every system sets was read with its usual value; this is assumed.", "loops": "A loop that decodes bytes with a constant key was computed.", "codes": "Character codes were turned into their characters.",
    "decoders": "A decoding call on a constant was carried out.", "concat": "Adjacent pieces of text were joined.", "methods": "A string method on a constant was carried out.", "calls_vb": "A string function on a constant was carried out.", "variables": "A variable set once was replaced by its text.",
    "parse": "Percent variables and carets were resolved as the command interpreter does.", "lines": "Continued lines were joined.", "members": "A member named by a string is shown with a dot.", "constants": "A named character constant was put in.", "search": "An encoded literal was read by the decoders that fit.", "casts": "A cast that changes nothing was removed.",
}


def explained(rule: Column) -> Column:
    return F.coalesce(*(F.when(rule == k, F.lit(v)) for k, v in EXPLANATIONS.items()), rule)
