"""Most frequent items in bounded memory (problem 7).

Method: a count-min sketch with conservative update per hash-partitioned
stream of values, plus a bounded heap of heavy candidates; the partitions are
disjoint by value, so their heaps are merged by putting them together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import cut, parallelism, ship, table

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
COMBINE_ROWS = 65_536


class Sketch:
    """Count-min sketch whose cells never fall below the count of any key in them; estimates are never too low."""

    def __init__(self, width: int, depth: int):
        self.bits = max(1, int(math.log2(width)))
        self.cells = np.zeros((depth, 1 << self.bits), dtype=np.int64)

    def add(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Conservative update by distinct uint64 keys; returns the new estimates."""
        with np.errstate(over="ignore"):
            at = [((keys ^ (keys >> np.uint64(29))) * _ODD[r]) >> np.uint64(64 - self.bits) for r in range(len(self.cells))]
        now = np.min([row[i] for row, i in zip(self.cells, at)], axis=0) + weights
        for row, i in zip(self.cells, at):
            np.maximum.at(row, i, now)
        return now


def combine(columns: list[str]):
    """Pre-aggregation before the shuffle: equal values of a task become one weighted row, by at most COMBINE_ROWS groups at a time."""

    def run(batches):
        held, rows = [], 0

        def flush():
            t = pa.Table.from_batches(held).group_by([*columns, "_h"]).aggregate([("_w", "sum")]).rename_columns([*columns, "_h", "_w"]).combine_chunks()
            return t.to_batches()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > 4 * COMBINE_ROWS:
                held = flush()
                rows = sum(x.num_rows for x in held)
                if rows > COMBINE_ROWS:
                    yield from held
                    held, rows = [], 0
        if held:
            yield from flush()

    return run


def sketch(columns: list[str], width: int, depth: int, heap: int):
    """One partition's stream through the sketch; gives its heap and, in a row without values, its total weight and the least estimate a full heap kept."""

    def run(batches):
        cms, total = Sketch(width, depth), 0
        kept = None
        floor = 0
        for b in batches:
            t = pa.Table.from_batches([b]).group_by([*columns, "_h"]).aggregate([("_w", "sum")]).rename_columns([*columns, "_h", "_w"])
            w = t["_w"].to_numpy().astype(np.int64)
            total += int(w.sum())
            est = cms.add(t["_h"].to_numpy().view(np.uint64), w)
            t = t.drop_columns(["_w"]).append_column("_est", pa.array(est))
            if kept is not None:
                t = pa.concat_tables([kept, t])
            t = t.group_by([*columns, "_h"]).aggregate([("_est", "max")]).rename_columns([*columns, "_h", "_est"])
            if t.num_rows > heap:
                e = t["_est"].to_numpy()
                order = np.argpartition(-e, heap)
                floor = max(floor, int(e[order[heap:]].max()))
                t = t.take(pa.array(order[:heap]))
            kept = t
        if kept is None:
            return
        out = kept.drop_columns(["_h"]).append_column("_total", pa.array([None] * kept.num_rows, pa.int64())).append_column("_floor", pa.array([None] * kept.num_rows, pa.int64()))
        yield from out.combine_chunks().to_batches()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, out.schema.field(c).type) for c in columns), pa.array([None], pa.int64()), pa.array([total], pa.int64()), pa.array([floor], pa.int64())], schema=out.schema)

    return run


def heavy_hitters(df: DataFrame, columns: list[str], one_in: int = 250, width: int = 1 << 14, depth: int = 4, heap: int = 2048, exact: bool = False) -> DataFrame:
    """The combinations of string columns that make up at least one in `one_in` rows.

    Gives the columns and approx_count, which is never below the true count;
    with exact=True a recount of the candidates alone gives `count` and removes
    those that only the sketch's error lifted. Memory: width x depth cells and
    `heap` values per partition, whatever the number of distinct values. Should
    a full heap have had to drop a value that could still reach the limit, the
    sketch is repeated with four times the width and heap, so nothing is lost.

    Nulls are values like any other; an empty table gives no rows; ties and
    repeated rows count as rows; other columns, whatever their names, are left
    out.
    """
    spark = df.sparkSession
    ship(spark)
    names = [f"_k{i}" for i in range(len(columns))]
    keyed = df.select(*(F.col(c).cast("string").alias(k) for c, k in zip(columns, names))).withColumn("_h", F.xxhash64(*names)).withColumn("_w", F.lit(1).cast("long"))
    schema = ", ".join(f"{k} string" for k in names)
    combined = keyed.mapInArrow(combine(names), f"{schema}, _h long, _w long")
    while True:
        heaps = cut(combined.repartition(parallelism(spark), "_h").mapInArrow(sketch(names, width, depth, heap), f"{schema}, _est long, _total long, _floor long"))
        total, floor = heaps.agg(F.sum("_total"), F.max("_floor")).first()
        limit = math.ceil((total or 0) / one_in)
        if not floor or floor < limit:
            break
        width, heap = width * 4, heap * 4
    found = heaps.where(F.col("_total").isNull() & (F.col("_est") >= max(limit, 1)))
    if not exact:
        return found.select(*(F.col(k).alias(c) for k, c in zip(names, columns)), F.col("_est").alias("approx_count"))
    # Estimates of at least the limit: a few more than one_in values, at most a heap for each partition. The recount is by partial sums.
    candidates = found.select(*(F.col(k).alias(f"c{k}") for k in names), "_est")
    few = candidates.count() <= 16_384
    same = [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in names]
    joined = keyed.select(*names).join(F.broadcast(candidates) if few else candidates, same)
    counted = joined.groupBy(*names).agg(F.count(F.lit(1)).alias("count"), F.max("_est").alias("approx_count"))
    return counted.where(F.col("count") * one_in >= (total or 0)).select(*(F.col(k).alias(c) for k, c in zip(names, columns)), "approx_count", "count")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_hitters(table(spark, folder, "findings"), ["type", "value"], exact=True).select("type", "value")


def p7_top_values(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_hitters(table(spark, folder, "findings"), ["type", "value"], one_in=1000)


QUERIES = {"p7_found": p7_found, "p7_top_values": p7_top_values}
SQL = {"p7_found": "SELECT type, value FROM findings GROUP BY type, value HAVING count(*) * 250 >= (SELECT count(*) FROM findings)"}
