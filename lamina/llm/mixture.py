"""Mixing sources to target weights (problem 9).

Method: systematic sampling. Within a source every document has an expected
number of copies; these are summed up along an order of the source, one random
offset is added, and the document is given once for each whole number that the
sum crosses on it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.tokens import VOCABULARY, count_tokens
from lamina.session import cut, parallelism, table


def plan(totals: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """Expected copies of a document by source: the largest mixture in which every source has its share and none exceeds its repeats.
    totals: documents and tokens by source. A source without tokens can't have its share; the others then keep theirs among each other."""
    live = {s: (w, r) for s, w, r in targets if w is not None and w > 0 and r is not None and r > 0 and totals.get(s, (0, 0))[1] > 0}
    if not live:
        return {}
    size = min(r * totals[s][1] / w for s, (w, r) in live.items())
    return {s: min(float(r), size * w / totals[s][1]) for s, (w, r) in live.items()}


def offset(source: str, seed: int) -> float:
    """The random offset of a source, in [0, 1): drawn from the seed, so that a task run again gives the same sample."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{source}".encode(), digest_size=8).digest()[:6], "big") / 2**48


def mix(items: DataFrame, targets: list[tuple[str, float, int]], seed: int = 20) -> DataFrame:
    """Items (item LONG, source STRING, size INT) with copies > 0: item, source, size, copies.

    The order within a source is by size, then by a hash, then item: each run
    of like sizes is thinned or repeated evenly, which keeps the tokens, not
    only the documents, at their share. The running sum is taken over a range
    partitioning: each partition sums up its own part, only its sums by source
    (partitions x sources numbers) go through the driver, so a source that
    holds most rows is spread over many tasks. Copies never exceed the
    source's repeats.

    Items with a null source or one without a target take no part, nor do
    those without size; an item twice is two items; an empty table or no
    targets give no rows.
    """
    spark = items.sparkSession
    targets = [t for t in targets if t[0] is not None]
    known = items.where(F.col("source").isin([t[0] for t in targets]) & (F.col("size") > 0)).select("item", "source", F.col("size").cast("int").alias("size")) if targets else items.where("false").select("item", "source", F.col("size").cast("int").alias("size"))
    # The range partitioning samples its input; without the first cut the texts would be counted twice.
    known = cut(cut(known).withColumn("_h", F.xxhash64("item", F.lit(seed))).repartitionByRange(parallelism(spark), "source", "size", "_h", "item").sortWithinPartitions("source", "size", "_h", "item").withColumn("_p", F.spark_partition_id()))
    parts = known.groupBy("_p", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t")).collect()  # partitions x sources rows
    totals: dict[str, tuple[int, int]] = {}
    for r in parts:
        n, t = totals.get(r["source"], (0, 0))
        totals[r["source"]] = (n + r["n"], t + r["t"])
    copies = plan(totals, targets)
    limits = {s: r for s, _, r in targets}
    before, start = {}, {}
    for r in sorted(parts, key=lambda r: r["_p"]):
        start[(r["_p"], r["source"])] = before.get(r["source"], 0)
        before[r["source"]] = before.get(r["source"], 0) + r["n"]

    def run(batches):
        import numpy as np

        rank: dict[str, int] = {}
        for b in batches:
            out = []
            for s in pc.unique(b.column("source")).to_pylist():
                part = b.filter(pc.equal(b.column("source"), s))
                if s not in copies:
                    continue
                if s not in rank:
                    rank[s] = start[(part.column("_p")[0].as_py(), s)]
                at = rank[s] + np.arange(part.num_rows + 1)
                rank[s] += part.num_rows
                crossed = np.minimum(np.diff(np.floor(at * copies[s] + offset(s, seed))).astype(np.int32), limits[s])
                part = pa.RecordBatch.from_arrays([part.column("item"), part.column("source"), part.column("size"), pa.array(crossed)], names=["item", "source", "size", "copies"])
                out.append(part.filter(pa.array(crossed > 0)))
            yield from out

    return known.mapInArrow(run, "item long, source string, size int, copies int")


def targets_of(spark: SparkSession, folder: str) -> list[tuple[str, float, int]]:
    """The sources with targets: a small fixed table, read with a limit it must not reach."""
    rows = table(spark, folder, "mix_targets").select("source", "target_share", "max_repeats").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 targets")
    return [tuple(r) for r in rows]


def _items(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents").where("source is not null").select("doc_id", "source", "text"), "text", vocabulary)
    return counted.select(F.col("doc_id").alias("item"), "source", F.col("tokens").alias("size"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(_items(spark, folder), targets_of(spark, folder))
    return mixed.select(F.col("item").alias("doc_id"), "source", F.col("size").alias("tokens"), "copies")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached: source, target_share, share, tokens, documents, most_copies."""
    targets = table(spark, folder, "mix_targets")
    reached = p9_mixture(spark, folder).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    total = reached.agg(F.sum("tokens")).first()[0] or 0  # one row a source before
    share = F.coalesce("tokens", F.lit(0)) / F.lit(float(total)) if total else F.lit(0.0)
    return targets.join(F.broadcast(reached) if total else reached, "source", "left").select("source", "target_share", share.alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
