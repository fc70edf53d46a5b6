"""Bloom filters in shards: every shard of the hashes has filters of its own, in a task of its own.

A task's share of a filter is sparse, so it is sent in its shortest form, the
distinct hashes; the shard's task merges the shares of all tasks into a filter
of what was seen once and one of what was seen again. Shards are as many as
the data need, so that neither a filter nor what it is asked grows; nothing
goes to the driver and nothing is broadcast.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import parallelism, remove, scratch, ship

HASHES = 4
#: Hashes that a shard is to get, and bits of a filter for each.
SHARD, BITS_EACH = 1 << 20, 16
_COMBINE = 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Bloom:
    """A filter of uint64 hashes; bits is rounded up to a power of two."""

    def __init__(self, bits: int, cells: np.ndarray | None = None):
        self.log = max(10, int(bits - 1).bit_length())
        self.cells = np.zeros(1 << (self.log - 3), np.uint8) if cells is None else cells

    @classmethod
    def read(cls, raw) -> Bloom:
        cells = np.frombuffer(raw, np.uint8).copy()
        return cls(8 * len(cells), cells)

    def _at(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.stack([((h ^ (h >> np.uint64(31))) * m) >> np.uint64(64 - self.log) for m in _ODD[:HASHES]])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self._at(h)
        return ((self.cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)

    def add(self, h: np.ndarray) -> None:
        if len(h):
            at = self._at(h).ravel()
            np.bitwise_or.at(self.cells, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def full(self) -> float:
        """Share of the bits that are set."""
        return float(np.unpackbits(self.cells).mean())


def _shares(batches):
    """(h, place, again): the distinct (h, place) of a task's rows, by _COMBINE rows at a time, and whether they came more than once."""

    def flush():
        t = pa.Table.from_batches(held).group_by(["h", "place"]).aggregate([([], "count_all")])
        return pa.table({"h": t["h"], "place": t["place"], "again": pa.array(t["count_all"].to_numpy() > 1)}).combine_chunks().to_batches()

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= _COMBINE:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def _shard(batches):
    """A shard's filters from the shares of all tasks; gives (place, h) of the shares whose hash the filter of the repeated has."""
    every = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not every:
        return
    size = BITS_EACH * sum(len(h) for h, _, _ in every)
    once, repeated = Bloom(size), Bloom(size)
    for h, _, again in every:
        u, at, n = np.unique(h, return_index=True, return_counts=True)
        flagged = np.unique(h[again])
        repeated.add(np.concatenate([u[once.has(u) | (n > 1)], flagged]))
        once.add(u)
    held = []
    for h, place, _ in every:
        keep = repeated.has(h)
        held.append(pa.table({"place": place[keep], "h": h[keep].view(np.int64)}))
    yield from pa.concat_tables(held).group_by(["place", "h"]).aggregate([]).combine_chunks().to_batches()


def repeated(hashes: DataFrame, rows: int) -> DataFrame:
    """(place, h) for each hash of the rows (h LONG, place INT) that may stand in two rows; every such hash is there, with each place that has it.
    rows: about how many there are."""
    ship(hashes.sparkSession)
    shares = hashes.select("h", "place").where("h is not null").mapInArrow(_shares, "h long, place int, again boolean")
    shards = max(parallelism(hashes.sparkSession), -(-rows // SHARD))
    return shares.repartition(shards, "h").mapInArrow(_shard, "place int, h long")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Split:
    """Rows of a table with a LONG column h, told apart by whether their hash may stand in another row too.

    The rows are written once, each task's to a bucket by its place; the
    places of the possible repeats come back from the shards and are joined
    bucket by bucket. So rows aren't shuffled for this, whatever their number:
    only distinct hashes are, with a place each.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder = scratch(self.spark, "split")
        name = "lamina_" + self.folder.rsplit("-", 1)[-1]
        placed = df.withColumn("place", F.spark_partition_id())
        buckets = max(1, placed._jdf.queryExecution().toRdd().getNumPartitions())
        placed.write.bucketBy(buckets, "place").option("path", f"{self.folder}/rows").saveAsTable(name)
        self.rows = self.spark.table(name)
        self.spark.catalog.refreshTable(name)
        marks = repeated(self.rows.select("h", "place"), self.rows.where("h is not null").count()).withColumn("again", F.lit(True))
        # The rows are in their buckets: only the marks move. Both parts are written while the setting that allows it holds.
        with _setting(self.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            told = self.rows.where("h is not null").join(marks, ["place", "h"], "left").drop("place")
            told.withColumn("again", F.coalesce("again", F.lit(False))).write.partitionBy("again").parquet(f"{self.folder}/told")
        schema = told.schema
        self.told = self.spark.read.schema(schema).parquet(f"{self.folder}/told")
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.folder}/rows")

    def again(self) -> DataFrame:
        return self.told.where("again").drop("again")

    def once(self) -> DataFrame:
        return self.told.where("not again").drop("again")
