"""Duplicates hidden by formatting differences (problem 1).

Method: canonical hashes go into partition-merged Bloom filters of hashes seen
once and seen repeatedly, one pair of filters for each shard of the hashes;
only rows that may be repeats are shuffled for exact grouping, all others are
singletons without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.filters import Split
from lamina.session import spread, table

#: Types whose value is one part however it is grouped.
BLOBS = ("hash_md5", "hash_sha1", "hash_sha256", "hash_partial", "base64_blob")


def _any_of(c: str, *pieces: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in pieces))


def canonical(df: DataFrame) -> DataFrame:
    """Rows (type, value, ...) with their key: the parts of an indicator in lower case with single blanks between; defanging, punctuation and blanks
    gone, name=value and /SWITCH value fields sorted behind whatever stands before them. A digest or Base64 blob is one part. Rows with a null
    type or value or a character outside ASCII in the value are left out.

    Each pattern is tried only where a plain test finds what it needs. Every step is a projection of its own: a step names the one before
    it several times, and in one expression it would be computed as often."""
    lower, names = F.lower("value"), df.columns
    steps = [
        F.replace(F.translate("_low", "\t\n\x0b\f\r", "     "), F.lit(" "), F.lit("  ")),
        F.when(_any_of("_v", "dot", "at") & _any_of("_v", "[", "(", "{"), F.regexp_replace("_v", r"[\[({]\s*(dot|at)\s*[\])}]", " ")).otherwise(F.col("_v")),
        F.when(_any_of("_v", "hxx", "h**"), F.regexp_replace("_v", r"(^|[^a-z0-9])h(?:xx|\*\*)p(s?)(\s*[\[(]?:)", "$1http$2$3")).otherwise(F.col("_v")),
        F.when(_any_of("_v", "/"), F.regexp_replace("_v", r"(^|[\s<>(\[{\"'`])/([a-z]+)(\s)", "\u0001/$2$3")).otherwise(F.col("_v")),
        F.when(_any_of("_v", "="), F.regexp_replace("_v", r"(^|[?&;|,\s])[\s\"'`<(\[]*([a-z_][a-z0-9_.-]*)\s*=", "\u0001$2=")).otherwise(F.col("_v")),
    ]
    out = df.where(F.col("type").isNotNull() & (F.octet_length("value") == F.length("value"))).withColumn("_kind", F.lower(F.regexp_replace("type", r"^\s+|\s+$", ""))).withColumn("_low", lower)
    for step in steps:
        out = out.withColumn("_v", step)

    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))

    chunks = F.transform(F.split("_v", "\u0001"), plain)
    out = out.withColumn("_c", F.when(F.contains("_v", F.lit("\u0001")), chunks))
    fields = F.array_sort(F.filter(F.slice("_c", 2, 1 << 30), lambda c: c != ""))
    text = F.when(F.col("_c").isNotNull(), F.trim(F.concat_ws(" ", F.element_at("_c", 1), fields))).otherwise(plain(F.col("_v")))
    parts = F.when(F.col("_kind").isin(*BLOBS), F.regexp_replace("_low", "[^a-z0-9]", "")).otherwise(text)
    return out.select(*names, F.concat_ws("\u0002", "_kind", parts).alias("key"))


def keyed_findings(findings: DataFrame) -> DataFrame:
    return canonical(spread(findings.select("id", "type", "value"))).withColumn("h", F.xxhash64("key"))


def collapse(findings: DataFrame) -> DataFrame:
    """One row for each indicator: rep_id (smallest id), type and value as the representative writes them, copies (findings behind it),
    variants (whether it occurs in more than one writing).

    Reads id, type, value. Nulls in type or value and values with a character
    outside ASCII state no comparable indicator and are left out; an empty
    value or one of punctuation alone is an indicator without parts; the same
    row twice counts twice, a null id counts but never represents; an empty
    table gives no rows.
    """
    split = Split(keyed_findings(findings))
    again, once = split.again(), split.once()
    writing = F.struct("type", "value")
    groups = again.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "type", "value")).alias("rep"), F.count(F.lit(1)).alias("copies"), (F.min(writing) != F.max(writing)).alias("variants"))
    many = groups.select(F.col("rep.id").alias("rep_id"), F.col("rep.type").alias("type"), F.col("rep.value").alias("value"), "copies", "variants")
    return many.unionByName(once.select(F.col("id").alias("rep_id"), "type", "value", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("variants")))


def copies(findings: DataFrame) -> DataFrame:
    """(rep_id, copy_id) for each indicator stated in at least two different writings; a row without an id is a writing too. See collapse() for the cases."""
    again = Split(keyed_findings(findings)).again()
    writing = F.struct("type", "value")
    groups = again.groupBy("key").agg(F.min("id").alias("rep_id"), F.min(writing).alias("least"), F.max(writing).alias("most"))
    cases = groups.where("least != most").select("key", "rep_id")
    # An inner join of a skewed side: adaptive execution splits a hot key's rows and repeats its one case row.
    return again.select("key", F.col("id").alias("copy_id")).join(cases, "key").where("copy_id != rep_id").select("rep_id", "copy_id").distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies(table(spark, folder, "findings"))


def p1_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return collapse(table(spark, folder, "findings"))


_KEYED = r"""
WITH a AS (SELECT id, type, value, lower(regexp_replace(type, '^\s+|\s+$', '', 'g')) AS kind,
  regexp_replace(lower(value), '\s', '  ', 'g') AS v FROM findings WHERE type IS NOT NULL AND value IS NOT NULL AND regexp_full_match(value, '[\x00-\x7F]*', 's')),
b AS (SELECT * REPLACE (regexp_replace(v, '[\[({]\s*(dot|at)\s*[\])}]', ' ', 'g') AS v) FROM a),
c AS (SELECT * REPLACE (regexp_replace(v, '(^|[^a-z0-9])h(?:xx|\*\*|tt)p(s?)(\s*[\[(]?:)', '\1http\2\3', 'g') AS v) FROM b),
d AS (SELECT * REPLACE (regexp_replace(v, '(^|[\s<>(\[{"''`])/([a-z]+)(\s)', chr(1) || '/\2\3', 'g') AS v) FROM c),
e AS (SELECT * REPLACE (regexp_replace(v, '(^|[?&;|,\s])[\s"''`<(\[]*([a-z_][a-z0-9_.-]*)\s*=', chr(1) || '\2=', 'g') AS v) FROM d),
f AS (SELECT *, list_transform(string_split(v, chr(1)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS chunks FROM e),
k AS (SELECT id, type, value, kind || chr(2) || CASE WHEN kind IN ('hash_md5', 'hash_sha1', 'hash_sha256', 'hash_partial', 'base64_blob') THEN regexp_replace(lower(value), '[^a-z0-9]', '', 'g')
  ELSE trim(array_to_string(list_concat([chunks[1]], list_sort(list_filter(chunks[2:], lambda x: x <> ''))), ' ')) END AS key FROM f)
"""
QUERIES = {"p1_found": p1_found, "p1_indicators": p1_indicators}
SQL = {
    "p1_found": _KEYED + ", g AS (SELECT key, min(id) AS rep_id FROM k GROUP BY key HAVING count(DISTINCT (type, value)) > 1) SELECT DISTINCT rep_id, id AS copy_id FROM k JOIN g USING (key) WHERE id <> rep_id",
    "p1_indicators": _KEYED + ", g AS (SELECT key, min(id) AS rep_id, count(*) AS copies, count(DISTINCT (type, value)) > 1 AS variants FROM k GROUP BY key) SELECT rep_id, type, value, copies, variants FROM g JOIN k ON k.id = rep_id",
}
