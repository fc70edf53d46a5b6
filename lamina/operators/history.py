"""Stored analyses: counts, history, retention, triage, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_counts(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """Analyses with finding_count and high_count. Findings are counted before the join, so a hot analysis costs one row of it."""
    per = findings.groupBy(F.col("analysis_id").alias("id")).agg(F.count("id").alias("finding_count"), F.count_if(F.col("severity") == "high").alias("high_count"))
    return analyses.join(per, "id", "left").fillna(0, ["finding_count", "high_count"])


def latest_batches(batches: DataFrame) -> DataFrame:
    """One row a batch: a finished state before a running one, then the later."""
    rest = [c for c in batches.columns if c != "id"]
    order = F.struct(F.col("completed_at").isNotNull(), "completed_at", "duration_ms", "status")
    return batches.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", "r.*")


def history(analyses: DataFrame, findings: DataFrame, batches: DataFrame) -> DataFrame:
    """Single analyses and batches as entries: kind, id, created_at, files, finding_count, high_count. One join and one aggregation, no loop over batches."""
    counted = with_counts(analyses.select("id", "created_at", "batch_id"), findings)
    singles = counted.where("batch_id IS NULL").select(F.lit("single").alias("kind"), "id", "created_at", F.lit(1).cast("long").alias("files"), "finding_count", "high_count")
    members = counted.where("batch_id IS NOT NULL").groupBy(F.col("batch_id").alias("id")).agg(F.count(F.lit(1)).alias("files"), F.sum("finding_count").alias("finding_count"), F.sum("high_count").alias("high_count"))
    whole = latest_batches(batches).select("id", F.coalesce("completed_at", "started_at").alias("created_at")).join(members, "id", "left").fillna(0, ["files", "finding_count", "high_count"])
    return singles.unionByName(whole.select(F.lit("batch").alias("kind"), "id", "created_at", "files", "finding_count", "high_count"))


def newest(entries: DataFrame, keep: int) -> DataFrame:
    """The newest entries, ties by kind and id: a bounded heap in each task, no sort of all."""
    return entries.orderBy(F.col("created_at").desc_nulls_last(), "kind", "id").limit(keep)


#: Where a row without a key stands in the order of the keys: before all.
_NO_KEY = -(1 << 62)


def beyond(entries: DataFrame, keep: int, order: str = "created_at", key: str = "id") -> DataFrame:
    """What retention deletes: all but the newest. The border is found by a top-k, then a filter streams over the rest; no window over everything."""
    border = entries.select(order, key).orderBy(F.col(order).desc_nulls_last(), key).limit(keep).agg(F.min(F.struct(F.coalesce(order, F.lit(float("-inf"))).alias("t"), (-F.coalesce(key, F.lit(_NO_KEY))).alias("k"))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if keep <= 0 or border["n"] < keep:
        return entries if keep <= 0 else entries.where("false")
    t, k = border["b"]["t"], -border["b"]["k"]
    at = F.coalesce(F.col(order), F.lit(float("-inf")))
    return entries.where((at < t) | ((at == t) & (F.coalesce(key, F.lit(_NO_KEY)) > k)))


def batch_rollup(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts by batch and analysis, by batch, and over all."""
    counted = with_counts(analyses.select("id", "batch_id"), findings)
    return counted.rollup("batch_id", "id").agg(F.sum("finding_count").alias("finding_count"), F.sum("high_count").alias("high_count"), F.grouping_id().alias("level"))


def latest_triage(log: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest state of each finding in an append-only log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("r")).select(key, "r.*")


def triage(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings with their stored triage by type and value; unreviewed where there is none. log: type, value, triage_status."""
    return findings.join(log.select("type", "value", F.col("triage_status").alias("_s")), ["type", "value"], "left").withColumn("triage_status", F.coalesce("_s", F.lit("unreviewed"))).drop("_s")


def empty_batches(batches: DataFrame, analyses: DataFrame) -> DataFrame:
    """Batches left without a member."""
    return batches.join(analyses.select(F.col("batch_id").alias("id")), "id", "left_anti")


def delete(analyses: DataFrame, findings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays when analyses (id) and, with them, their findings go."""
    return analyses.join(ids, "id", "left_anti"), findings.join(ids.withColumnRenamed("id", "analysis_id"), "analysis_id", "left_anti")


def add_to_store(path: str, **tables: DataFrame) -> None:
    """Appends tables to a store; columns that came later are merged on reading."""
    for name, df in tables.items():
        df.write.mode("append").option("mergeSchema", "true").parquet(f"{path}/{name}")


def layer_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("analysis_id", "layer").agg(F.count(F.lit(1)).alias("findings"))


def submission(files: DataFrame, most_files: int = 200, most_bytes: int = 5_000_000, total: int = 100_000_000) -> DataFrame:
    """Files (submission, ord, name, content) with skip_reason: type, empty and size skip a file; count and budget end the submission.

    Running sums are per submission, whose files are few; nothing is dropped, the reason says why a file isn't taken.
    """
    from lamina.functions.text import extension_allowed

    size = F.length("content")
    own = F.when(~extension_allowed(F.col("name")), "type").when(size == 0, "empty").when(size > most_bytes, "size")
    w = Window.partitionBy("submission").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = files.withColumn("_own", own).withColumn("_n", F.count(F.when(F.col("_own").isNull(), 1)).over(w)).withColumn("_b", F.sum(F.when(F.col("_own").isNull(), size).otherwise(0)).over(w))
    return marked.withColumn("skip_reason", F.coalesce(F.when(F.col("_n") > most_files, "count"), F.when(F.col("_b") > total, "budget"), F.col("_own"))).drop("_own", "_n", "_b")
