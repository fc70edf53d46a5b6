"""The library's front door: what a user does with scripts and with what was stored of them, each in one call on DataFrames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import refang
from lamina.operators import enrich, history, layers


class Analysis(NamedTuple):
    """layers: a row for each layer of each script. findings: its indicators with the layer they belong to. trees: a row for each script."""

    layers: DataFrame
    findings: DataFrame
    trees: DataFrame


def analyze(scripts: DataFrame, key: str = "id", text: str = "text") -> Analysis:
    """Scripts (key, text), rewritten and opened layer by layer, with their indicators. Lazy: nothing runs before a result is asked for but what layer_findings() writes."""
    found = layers.layers(scripts, key, text)
    return Analysis(found, layers.layer_findings(found, key), layers.tree(found, key))


def lookup(values: DataFrame, cache: DataFrame, now: float, value: str = "value", requested: str | None = None, ttl: float = enrich.DAY) -> DataFrame:
    """Values with the type they are looked up as, each provider that can be asked, why it isn't (skip), and the verdict the cache has (verdict, detail, fetched_at)."""
    kind = enrich.resolve_type(F.col(value), F.col(requested) if requested else F.lit("auto"))
    typed = values.withColumns({"type": kind, "value": refang(enrich.stripped(F.col(value)))}).where("type IS NOT NULL")
    asked = enrich.capabilities(typed).withColumn("skip", enrich.skip_reason(F.col("type"), F.col("value"))).withColumnRenamed("provider", "source")
    return enrich.cached(asked, cache, now, ttl)


def newest(analyses: DataFrame, findings: DataFrame, batches: DataFrame, keep: int = 50) -> DataFrame:
    """The newest entries of the history: single analyses and batches with their counts."""
    return history.newest(history.history(analyses, findings, batches), keep)


def stored(analyses: DataFrame, findings: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """The stored analyses of some ids and their findings; the ids reach the scans as filters."""
    return analyses.where(F.col("id").isin(*ids)), findings.where(F.col("analysis_id").isin(*ids))
