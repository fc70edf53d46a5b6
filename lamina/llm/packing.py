"""Filling fixed-capacity containers with items (problem 8).

Method: conflict-constrained best-fit. Items come in falling size; the open
bins are ordered by what is left in them and carry bitmaps of the sources and
of the duplicate clusters they hold. From the tightest bin that an item fits,
the search goes on to its successors until a compatible one is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.tokens import VOCABULARY, count_tokens
from lamina.session import cut, table

#: Items packed by one task; the bound of its memory.
GROUP = 16_384


class _Open:
    """Open bins by residual, and of one residual by the bitmap of their sources, so that equally tight bins are searched by kind and not one by one."""

    def __init__(self):
        self.residuals: list[int] = []
        self.bins: dict[int, dict[int, list[int]]] = {}

    def put(self, residual: int, mask: int, b: int) -> None:
        if residual not in self.bins:
            insort(self.residuals, residual)
            self.bins[residual] = {}
        self.bins[residual].setdefault(mask, []).append(b)

    def take(self, least: int, source: int, conflicts) -> tuple[int, int] | None:
        """(residual, bin) of the tightest bin of at least that residual without a conflict; of equally tight ones, one without the source."""
        at = bisect_left(self.residuals, least)
        while at < len(self.residuals):
            residual = self.residuals[at]
            kinds = self.bins[residual]
            for mask in sorted(kinds, key=lambda m: m & source != 0):
                held = kinds[mask]
                k = next((k for k in range(len(held) - 1, -1, -1) if not conflicts(held[k])), None)
                if k is not None:
                    b = held.pop(k)
                    if not held:
                        del kinds[mask]
                    if not kinds:
                        del self.bins[residual], self.residuals[at]
                    return residual, b
            at += 1
        return None


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin number of each item. Two items of one cluster never share a bin; of equally tight bins, one without the item's source is taken."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    seen = Counter(clusters)
    cluster_bit = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], cluster_bit.get(clusters[i], -1), i))
    bins, holds_source, holds_cluster = _Open(), [], []
    out = [0] * len(sizes)
    last, reached = None, 0
    for i in order:
        size, c, s = sizes[i], cluster_bit.get(clusters[i]), source_bit[sources[i]]
        # Items of one size and cluster follow each other: bins the last one passed hold the cluster, so the next begins where it ended.
        least = max(size, reached) if c is not None and (size, c) == last else size
        found = bins.take(least, s, (lambda b: False) if c is None else (lambda b: holds_cluster[b] >> c & 1))
        if found is None:
            residual, b = capacity, len(holds_source)
            holds_source.append(0)
            holds_cluster.append(0)
        else:
            residual, b = found
        last, reached = (size, c), residual
        holds_source[b] |= s
        if c is not None:
            holds_cluster[b] |= 1 << c
        if residual > size:
            bins.put(residual - size, holds_source[b], b)
        out[i] = b
    return out


def _pack(key, t):
    capacity = t.column("capacity")[0].as_py()
    t = t.sort_by([("item", "ascending"), ("piece", "ascending")])
    bins = best_fit(t.column("size").to_pylist(), t.column("source").to_pylist(), t.column("cluster").to_pylist(), capacity)
    return t.append_column("bin", pa.array(bins, pa.int64()))


def pack(items: DataFrame, containers: list[tuple[str, int]], full: float = 0.98, gain: float = 0.9) -> DataFrame:
    """Items (item LONG, source, cluster LONG, size INT) into containers of each kind (kind, capacity).

    Gives kind, capacity, bin, item, piece, first_token, size, fill (share of
    the bin in use). An item larger than the capacity, and only such, is cut:
    into pieces that fill a bin each and a last one that is packed like an
    item. Copies (items of one cluster) never share a bin; items of a null
    cluster have no copies. Work is split into groups of at most about GROUP
    items by hash, so no group grows with the data; what lies in bins filled
    below `full` is dealt out anew, until it is one group or a round leaves
    more than `gain` of what it was given. Pieces of a full bin need no search.

    Null or negative sizes and sizes of 0 take no room and are left out; a
    null source is a source; an item twice is two items; no items or no
    containers give no rows.
    """
    spark = items.sparkSession
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(int(c)).alias("capacity")) for k, c in containers)) if containers else F.expr("cast(array() as array<struct<kind:string,capacity:int>>)")
    base = items.where("size > 0").select("item", F.col("source").cast("string"), F.col("cluster").cast("long"), F.col("size").cast("int").alias("whole"), F.explode(kinds).alias("k")).select("item", "source", "cluster", "whole", "k.*")
    pieces = base.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("whole") - 1) / F.col("capacity")).cast("int")))).select(
        "kind", "capacity", "item", "source", "cluster", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.least(F.col("capacity"), F.col("whole") - F.col("piece") * F.col("capacity")).alias("size")
    )
    schema = "kind string, capacity int, item long, source string, cluster long, piece int, first_token int, size int, grp long, bin long"
    columns = ["kind", "capacity", "item", "piece", "first_token", "size", "bin", "fill"]
    cut_ = cut(pieces)
    alone = cut_.where("size = capacity").select(*columns[:6], F.concat_ws("-", F.lit("f"), "item", "piece", F.monotonically_increasing_id()).alias("bin"), F.lit(1.0).alias("fill"))
    todo, done = cut_.where("size < capacity"), []
    turn, before = 0, None
    while True:
        count = {r["kind"]: r["n"] for r in todo.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a kind
        if not count:
            break
        groups = F.coalesce(*(F.when(F.col("kind") == k, F.lit(-(-n // GROUP))) for k, n in count.items()), F.lit(1))
        placed = cut(
            todo.withColumn("grp", F.pmod(F.xxhash64("item", "piece", F.lit(turn)), groups).cast("long"))
            .groupBy("kind", "grp").applyInArrow(_pack, schema)
            .withColumn("bin", F.concat_ws("-", F.lit(turn), "grp", "bin"))
        )
        filled = placed.withColumn("fill", F.sum("size").over(_window("kind", "bin")) / F.col("capacity"))
        now = sum(count.values())
        last = all(n <= GROUP for n in count.values()) or before is not None and now > gain * before
        done.append((filled if last else filled.where(F.col("fill") >= full)).select(*columns))
        if last:
            break
        todo, turn, before = cut(filled.where(F.col("fill") < full).drop("grp", "bin", "fill")), turn + 1, now
    done.append(alone)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _window(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def document_items(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents").select("doc_id", "source", "text"), "text", vocabulary)
    return counted.select(F.col("doc_id").alias("item"), "source", F.col("content").alias("cluster"), F.col("tokens").alias("size"))


def containers(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The kinds of containers: a small fixed table, read with a limit it must not reach."""
    rows = table(spark, folder, "containers").where("capacity_tokens > 0").limit(101).collect()
    if len(rows) > 100:
        raise ValueError("more than 100 kinds of containers")
    return [(r["container_kind"], r["capacity_tokens"]) for r in rows]


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(document_items(spark, folder), containers(spark, folder))
    return packed.select(F.col("kind").alias("container_kind"), F.col("bin").alias("container"), F.col("item").alias("doc_id"), "piece", "first_token", F.col("size").alias("tokens"), "fill")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """For each kind: containers used, tokens in them, share of the room that is used."""
    packed = p8_packing(spark, folder)
    by = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"), F.max("fill").alias("fill"))
    return by.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.avg("fill").alias("fill"))


QUERIES = {"p8_packing": p8_packing, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
