"""Exports: finding rows, CSV that spreadsheets don't run, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import defang, spreadsheet_safe


def finding_rows(findings: DataFrame, intel: DataFrame | None = None, geo: DataFrame | None = None) -> DataFrame:
    """Rectangular finding rows, with verdict (finding_id, verdict) and geography (value, ...) where given."""
    out = findings.withColumn("defanged_value", defang(F.col("value"), F.col("type")))
    if intel is not None:
        out = out.join(intel.withColumnRenamed("finding_id", "id"), "id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("not checked")))
    return out if geo is None else out.join(geo, "value", "left")


def guarded(df: DataFrame) -> DataFrame:
    """All text cells safe for spreadsheets."""
    return df.select(*(spreadsheet_safe(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    guarded(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def reports(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """One canonical JSON report for each analysis: its findings in order, counts by severity."""
    item = F.struct("type", "value", "severity", "mitre", "layer")
    per = findings.groupBy(F.col("analysis_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("iocs"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low", "info")))
    body = F.struct(F.lit("1.0").alias("schema_version"), F.col("id").alias("analysis_id"), "filename", "status", "pipeline", F.struct("high", "medium", "low", "info").alias("severities"), "iocs")
    return analyses.join(per, "id", "left").select("id", F.to_json(body).alias("report"))


def write_reports(analyses: DataFrame, findings: DataFrame, path: str) -> None:
    reports(analyses, findings).write.mode("overwrite").json(path)
