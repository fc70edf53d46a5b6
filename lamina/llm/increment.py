"""Deduplicating new batches against all history (problem 4).

Method: a text's set of three-word runs is winnowed to content fingerprints.
Partitioned Bloom filters of everything accepted tell which fingerprints of a
new batch may be known; only those are looked up in the persistent fingerprint
store. Candidates are verified by the share of runs the two texts have in
common, and what is accepted goes into the store and its filters.

The store is read by key: a task that is asked about some fingerprints, or for
the runs of some texts, opens the files of its part, and of these only the row
groups whose bounds hold what is asked. So a batch reads what it hits, and
history is neither scanned nor shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.filters import BITS_EACH, Bloom
from lamina.session import cut, parallelism, remove, scratch, ship, spread, table

RUN = 3
WINDOW = 4
SHARED = 0.7
#: Texts of at most SHORT different runs ask by every run that pigeonholes demand; whatever they can match has at most INDEXED, and is found by every run.
SHORT, INDEXED = 32, 46
#: Share of a longer text's windows (and a few more) that edits may touch while SHARED of the runs stay common: substituting,
#: inserting, deleting or moving words breaks a neighbourhood of RUN + WINDOW - 1 runs at most for each 0.068 to 0.088 of the runs.
TOUCHED, MORE = 0.45, 4
#: Fingerprints of a part, at which the store doubles its parts, and texts of a slot.
PART, SLOT = 1 << 18, 4096
#: Bytes of a row group in the store: what one answer reads at least.
GROUP = 1 << 20
#: Batches after which the small files of the parts are put together.
COMPACT = 16


def runs_of(words: list[str], hashes: np.ndarray) -> np.ndarray:
    """Hashes of the different runs of RUN neighbouring words, in the order they first stand in."""
    if len(words) < RUN:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(words) - RUN + 1
        h = hashes[:n] * np.uint64(0x9E3779B97F4A7C15) + (hashes[1 : n + 1] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2 : n + 2] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def winnow(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints among the runs and the number of windows of WINDOW runs whose least hash each is. A text of at most SHORT
    runs has every run, for one window each; one of at most INDEXED has every run, for no window where it isn't the least."""
    n = len(runs)
    if n <= SHORT:
        return np.arange(n, dtype=np.int32), np.ones(n, np.int32)
    least = runs[: n - WINDOW + 1]
    for i in range(1, WINDOW):
        least = np.minimum(least, runs[i : n - WINDOW + 1 + i])
    prints, cover = np.unique(least, return_counts=True)
    order = np.argsort(runs)
    at = order[np.searchsorted(runs[order], prints)]
    if n <= INDEXED:
        every = np.zeros(n, np.int32)
        every[at] = cover
        return np.arange(n, dtype=np.int32), every
    sort = np.argsort(at)
    return at[sort].astype(np.int32), cover[sort].astype(np.int32)


DOCS = "id long, at double, n int, slot long, runs array<long>, prints array<long>, cover array<int>"


def _fingerprint(batches):
    import pandas as pd

    for b in batches:
        for at in range(0, b.num_rows, 400):
            part = b.slice(at, 400)
            texts = [(t or "").lower().split() for t in part.column(3).to_pylist()]
            flat = [w for t in texts for w in t]
            hashes = pd.util.hash_array(np.array(flat, dtype=object)) if flat else np.zeros(0, np.uint64)
            start, out = 0, []
            for words in texts:
                runs = runs_of(words, hashes[start : start + len(words)])
                start += len(words)
                chosen, cover = winnow(runs)
                out.append((len(runs), runs.view(np.int64), runs[chosen].view(np.int64), cover))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([x[0] for x in out], pa.int32()), part.column(2), *(pa.array([x[i] for x in out], pa.list_(t)) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32())))],
                names=["id", "at", "n", "slot", "runs", "prints", "cover"],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (id LONG, at DOUBLE, slot LONG, text) with n different runs, the runs, those of them that are fingerprints (prints), and how many windows each of these covers."""
    ship(docs.sparkSession)
    return docs.select("id", "at", "slot", "text").mapInArrow(_fingerprint, DOCS)


# -- reading by key, in Python workers


def _files(folder: str):
    """(file system, paths) of the Parquet files of a folder; none where there is no such folder."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if "://" in folder else "file://" + folder.removeprefix("file:"))
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return system, sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))


def _asked(folder: str, key: str, wanted: np.ndarray, columns: list[str]):
    """Tables of the rows in the files of a folder whose key is in the sorted `wanted`; reads only row groups whose bounds hold one of them."""
    import pyarrow.parquet as pq

    system, paths = _files(folder)
    for path in paths:
        with system.open_input_file(path) as source:
            f = pq.ParquetFile(source)
            place = f.schema_arrow.names.index(key)
            for g in range(f.num_row_groups):
                column = next(c for c in (f.metadata.row_group(g).column(i) for i in range(f.metadata.num_columns)) if c.path_in_schema == key) if place else f.metadata.row_group(g).column(0)
                bounds = column.statistics
                if bounds is not None and bounds.has_min_max:
                    k = np.searchsorted(wanted, bounds.min)
                    if k == len(wanted) or wanted[k] > bounds.max:
                        continue
                keys = f.read_row_group(g, [key]).column(0).to_numpy()
                hit = np.isin(keys, wanted)
                if hit.any():
                    yield f.read_row_group(g, columns).filter(pa.array(hit))


def _parts(batches, column: str):
    """The rows of a task by the value of an integer column: (value, table)."""
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held).combine_chunks().sort_by(column)
        values, starts = np.unique(t.column(column).to_numpy(), return_index=True)
        for v, a, b in zip(values, starts, [*starts[1:], t.num_rows]):
            yield int(v), t.slice(a, b - a)


class FingerprintStore:
    """What was accepted so far, in a folder: postings (print, id, at, n, slot) by part of the fingerprints, a Bloom filter of each part's
    fingerprints for each batch, and docs (the runs of all texts) by slot. It can be opened again by its path.

    Parts double when they hold more than PART fingerprints each, so neither a
    filter (BITS_EACH bits for each of PART) nor a part grows with history; the
    rewriting this takes is spread over the batches that made it grow.
    """

    def __init__(self, spark: SparkSession, path: str, part: int = PART):
        self.spark, self.path, self.most = spark, path, part
        self.version, self.generation, self.parts, self.prints, self.latest, self.fresh = 0, 0, 1, 0, None, 0
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/state")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            last = spark.read.parquet(f"{path}/state").orderBy(F.col("version").desc()).first()
            self.version, self.generation, self.parts, self.prints, self.latest, self.fresh = last["version"], last["generation"], last["parts"], last["prints"], last["latest"], last["fresh"]

    @property
    def empty(self) -> bool:
        return self.version == 0

    @property
    def bits(self) -> int:
        return BITS_EACH * self.most

    def part(self, column):
        return F.pmod(F.hash(column), F.lit(self.parts))

    def postings(self) -> DataFrame:
        return self.spark.read.schema("print long, id long, at double, n int, slot long, part int").parquet(f"{self.path}/postings/{self.generation}")

    def stage(self, docs: DataFrame, rows: int) -> DataFrame:
        """Writes the runs and fingerprints of a batch's texts (id, at, text) by slot, and gives what is needed of them (DOCS without runs)."""
        slots = max(1, -(-rows // SLOT))
        slot = F.pmod(F.hash("id"), F.lit(slots)) + F.lit((self.version + 1) << 24)
        placed = docs.withColumn("slot", slot.cast("long")).repartition(max(slots, parallelism(self.spark)), "slot").sortWithinPartitions("slot", "id")
        where = f"{self.path}/docs/{self.version + 1}"
        fingerprints(placed).where("n > 0").write.option("parquet.block.size", GROUP).partitionBy("slot").parquet(where)
        return self.spark.read.schema(DOCS).parquet(where).drop("runs")

    def known(self, prints: DataFrame) -> DataFrame:
        """(print, held): for the distinct prints that stand in the store, how many texts hold each. A part's filters are asked before its files."""
        folder, bits = f"{self.path}", self.bits
        gen = self.generation

        def run(batches):
            for part, t in _parts(batches, "part"):
                h = np.sort(t.column("print").to_numpy())
                maybe = np.zeros(len(h), bool)
                for cells in _asked_filters(f"{folder}/filters/{gen}/part={part}"):
                    maybe |= Bloom(bits, cells).has(h.view(np.uint64))
                if maybe.any():
                    found = [x.column(0).to_numpy() for x in _asked(f"{folder}/postings/{gen}/part={part}", "print", h[maybe], ["print"])]
                    if found:
                        u, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["print", "held"])

        return self._by_part(prints.select("print", self.part("print").alias("part"))).mapInArrow(run, "print long, held long")

    def holders(self, prints: DataFrame) -> DataFrame:
        """(print, other, other_at, other_n, other_slot) for the distinct prints asked: the texts that hold them."""
        folder, gen, columns = self.path, self.generation, ["print", "id", "at", "n", "slot"]

        def run(batches):
            for part, t in _parts(batches, "part"):
                for x in _asked(f"{folder}/postings/{gen}/part={part}", "print", np.sort(t.column("print").to_numpy()), columns):
                    yield from x.rename_columns(["print", "other", "other_at", "other_n", "other_slot"]).combine_chunks().to_batches()

        return self._by_part(prints.select("print", self.part("print").alias("part"))).mapInArrow(run, "print long, other long, other_at double, other_n int, other_slot long")

    def _by_part(self, df: DataFrame) -> DataFrame:
        return df.repartition(max(parallelism(self.spark), min(self.parts, 1 << 16)), "part")

    def runs(self, df: DataFrame, key: str, slot: str, then, schema: str) -> DataFrame:
        """Gives `then` each slot's rows of df, with the runs of the texts that `key` names in it as {id: array}."""
        folder = self.path

        def run(batches):
            for s, t in _parts(batches, slot):
                ids = np.unique(t.column(key).to_numpy())
                held = {}
                for x in _asked(f"{folder}/docs/{s >> 24}/slot={s}", "id", ids, ["id", "runs"]):
                    held.update(zip(x.column(0).to_pylist(), (np.asarray(r.values) for r in x.column(1))))
                yield from then(t, held).to_batches()

        return df.repartition(parallelism(self.spark), slot).mapInArrow(run, schema)

    def add(self, accepted: DataFrame, latest: float | None) -> None:
        """Takes in the fingerprints of accepted texts (DOCS without runs) and a filter of them for each part."""
        rows = accepted.select(F.explode("prints").alias("print"), "id", "at", "n", "slot")
        fresh = accepted.agg(F.sum(F.size("prints"))).first()[0] or 0
        self.prints += fresh
        self.version += 1
        self.fresh += 1
        self.latest = latest if self.latest is None else max(self.latest, latest if latest is not None else self.latest)
        if self.prints > self.most * self.parts or self.fresh > COMPACT:
            old = self.generation
            rows = rows.unionByName(self.postings().drop("part")) if self.version > 1 else rows
            while self.prints > self.most * self.parts:
                self.parts *= 2
            self.generation, self.fresh = self.version, 0
            self._write(rows)
            remove(self.spark, f"{self.path}/postings/{old}")
            remove(self.spark, f"{self.path}/filters/{old}")
        else:
            self._write(rows)
        self.spark.createDataFrame([(self.version, self.generation, self.parts, self.prints, self.latest, self.fresh)], "version int, generation int, parts int, prints long, latest double, fresh int").coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def _write(self, rows: DataFrame) -> None:
        placed = self._by_part(rows.withColumn("part", self.part("print"))).sortWithinPartitions("part", "print")
        placed.write.mode("append").option("parquet.block.size", GROUP).partitionBy("part").parquet(f"{self.path}/postings/{self.generation}")
        bits = self.bits
        folder, gen, stamp = self.path, self.generation, self.version

        def build(batches):
            for part, t in _parts(batches, "part"):
                b = Bloom(bits)
                b.add(np.unique(t.column("print").to_numpy()).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b.cells.tobytes()], pa.binary())], names=["part", "cells"])

        self._by_part(rows.select("print", self.part("print").alias("part")).distinct()).mapInArrow(build, "part int, cells binary").write.mode("append").partitionBy("part").parquet(f"{folder}/filters/{gen}")


def _asked_filters(folder: str):
    import pyarrow.parquet as pq

    system, paths = _files(folder)
    for path in paths:
        with system.open_input_file(path) as source:
            for cells in pq.ParquetFile(source).read(["cells"]).column(0):
                yield np.frombuffer(cells.as_buffer(), np.uint8)


# -- which texts a text asks, and what comes of it


def _picked(asking: DataFrame) -> DataFrame:
    """The rows of asking (id, at, n, slot, windows, print, cover, df) by which each text asks: its rarest fingerprints. A short text asks by as many
    runs as leave fewer than SHARED of its runs unasked; a longer one until they stand for more windows than edits may touch."""
    rare = Window.partitionBy("id").orderBy("df", "print").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("id")
    # What no other text has can't find one, but stands for windows that are gone.
    least = F.ceil(F.col("n") * SHARED - 1e-9)
    return (
        asking.where("cover > 0")
        .withColumn("lone", F.col("windows") - F.sum("cover").over(every))
        .withColumn("before", F.coalesce(F.sum("cover").over(rare), F.lit(0)) + F.col("lone"))
        .where(F.when(F.col("n") <= SHORT, F.col("before") <= F.col("n") - least).otherwise(F.col("before") <= F.col("windows") * TOUCHED + MORE))
        .drop("lone", "before", "windows", "cover", "df")
    )


def _alike(n, other):
    """Whether sets of these sizes can share SHARED of their union."""
    return F.least(n, other) >= F.greatest(n, other) * SHARED - 1e-9


PAIR = ("id", "at", "slot", "other", "other_at", "other_slot")


def _pairs(picked: DataFrame, holders: DataFrame) -> DataFrame:
    """PAIR for each asking text with each holder (print, other, other_at, other_n, other_slot) of a picked fingerprint that can be alike by size."""
    return picked.join(holders, "print").where(_alike(F.col("n"), F.col("other_n"))).select(*PAIR).distinct()


def _first(matches: DataFrame) -> DataFrame:
    return matches.groupBy("id").agg(F.min(F.struct("other_at", "other")).alias("f")).select("id", F.col("f.other").alias("other"), F.col("f.other_at").alias("other_at"))


def _verify(pairs: DataFrame, store: FingerprintStore) -> DataFrame:
    """(id, at, other, other_at) of the pairs of which SHARED of the different runs of either are in both. The runs of the one are sent to the slot of the other."""

    def attach(t: pa.Table, held: dict) -> pa.Table:
        return t.append_column("runs", pa.array([held[i] for i in t.column("id").to_pylist()], pa.list_(pa.int64())))

    def test(t: pa.Table, held: dict) -> pa.Table:
        keep = []
        for other, runs in zip(t.column("other").to_pylist(), t.column("runs")):
            a, b = np.asarray(runs.values), held[other]
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= SHARED * (len(a) + len(b) - both))
        return t.select(["id", "at", "other", "other_at"]).filter(pa.array(keep, pa.bool_()))

    schema = "id long, at double, slot long, other long, other_at double, other_slot long"
    sent = store.runs(pairs.select(*PAIR), "id", "slot", attach, schema + ", runs array<long>")
    return store.runs(sent, "other", "other_slot", test, "id long, at double, other long, other_at double")


def _within(shared: DataFrame, picked: DataFrame, store: FingerprintStore) -> DataFrame:
    """All verified pairs among a batch's own texts that can matter, without pairing the members of a family of near-copies with each other.

    First each text asks only the earliest holder of each fingerprint it picked
    (of its own range of sizes): a pair for each fingerprint at most. Holders
    that find nobody before them are accepted for sure, so what matches one of
    them is a duplicate for sure and is no partner any more. Then every text
    asks all that are left and come before it, and before the match it has.
    """
    order = F.struct("at", "id")
    holder = shared.select("print", F.col("id").alias("other"), F.col("at").alias("other_at"), F.col("n").alias("other_n"), F.col("slot").alias("other_slot"))
    earliest = holder.groupBy("print").agg(F.min(F.struct("other_at", "other", "other_n", "other_slot")).alias("l")).select("print", "l.*")
    earlier = F.struct("other_at", "other") < order
    asked = cut(_pairs(picked, earliest).where(earlier))
    sure = asked.join(asked.select(F.col("id").alias("other")).distinct(), "other", "left_anti")
    matched = cut(_first(_verify(sure, store)))
    best = matched.select("id", F.col("other").alias("mo"), F.col("other_at").alias("mt"))
    left = holder.join(matched.select(F.col("id").alias("other")), "other", "left_anti")
    rest = _pairs(picked, left).where(earlier).join(best, "id", "left")
    rest = rest.where(F.col("mo").isNull() | (F.struct("other_at", "other") < F.struct("mt", "mo"))).select(*PAIR)
    at = picked.select("id", "at").distinct()
    return _verify(rest, store).unionByName(matched.join(at, "id").select("id", "at", "other", "other_at"))


def _resolve(pairs: DataFrame) -> DataFrame:
    """(id, other): in the order of (at, id), a text with an accepted partner before it is a duplicate of the first such; else it is accepted.

    Works off the order in rounds: a text is settled once the earliest of its
    partners is; as partners are earlier, each round settles at least the first.
    """
    open_ = cut(pairs)
    done = None
    while True:
        waiting = open_.select("id").distinct()
        # Partners that aren't waiting themselves are accepted: duplicates are taken out of open_ as they are found.
        ready = open_.join(waiting.select(F.col("id").alias("other"), F.lit(True).alias("waits")), "other", "left")
        state = ready.groupBy("id").agg(F.min(F.struct("other_at", "other")).alias("first"), F.min(F.when(F.col("waits").isNull(), F.struct("other_at", "other"))).alias("sure"))
        found = cut(state.where(F.col("sure").isNotNull() & (F.col("sure") == F.col("first"))).select("id", F.col("sure.other").alias("other")))
        if found.isEmpty():
            return done if done is not None else found
        done = found if done is None else done.unionByName(found)
        # Settled duplicates ask no more and are no partner; whose partners are all gone is accepted.
        gone = found.select("id")
        open_ = cut(open_.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("other")), "other", "left_anti").select("id", "at", "other", "other_at"))


def ingest(docs: DataFrame, store: FingerprintStore) -> DataFrame:
    """One batch (id LONG, at DOUBLE, text): gives (id, other) for each duplicate with the first accepted text it matches, and updates the store.

    Every `at` must be later than all that the store has; an earlier one raises
    ValueError. Texts with no run of RUN words (null, empty, very short) match
    nothing and are accepted without a fingerprint; null ids are left out;
    exact copies of one another are compared once; equal `at` go by id; an
    empty batch changes nothing.
    """
    docs = docs.where("id is not null and text is not null").withColumn("mark", F.md5("text"))
    # Exact copies: the first stands for all, the rest follow it, or what it is a duplicate of. Partial minima, so a text of very many copies is no hot key.
    first = docs.groupBy("mark").agg(F.min(F.struct("at", "id", "text")).alias("f"), F.count(F.lit(1)).alias("copies"))
    span = docs.agg(F.min("at"), F.max("at"), F.count(F.lit(1))).first()
    if not span[2]:
        return docs.select("id", F.col("id").alias("other"))
    if store.latest is not None and span[0] <= store.latest:
        raise ValueError(f"a batch at {span[0]} comes after one at {store.latest} was taken in")
    reps = store.stage(first.select("f.id", "f.at", "f.text"), span[2])
    lead = docs.groupBy("mark").agg(F.min(F.struct("at", "id")).alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("mark", F.col("f.id").alias("lead"))
    # Texts without a run match nothing, their copies neither.
    copies = cut(docs.select("id", "mark").join(lead, "mark").where("id != lead").select("id", "lead").join(reps.select(F.col("id").alias("lead")), "lead", "left_semi"))
    windows = F.aggregate("cover", F.lit(0), lambda a, x: (a + x).cast("int")).alias("windows")
    prints = reps.select("id", "at", "n", "slot", windows, F.explode(F.arrays_zip("prints", "cover")).alias("p")).select("id", "at", "n", "slot", "windows", F.col("p.prints").alias("print"), F.col("p.cover").alias("cover"))
    counted = prints.groupBy("print").agg(F.count(F.lit(1)).alias("own"))
    if not store.empty:
        counted = cut(counted)
        counted = counted.join(store.known(counted), "print", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    else:
        counted = counted.withColumn("held", F.lit(0))
    several = counted.where("own > 1 or held > 0")
    shared = cut(prints.join(several, "print").withColumn("df", F.col("own") + F.col("held")))
    picked = cut(_picked(shared.drop("own")))
    known = None
    if not store.empty:
        asked = picked.where("held > 0")
        pairs = _pairs(asked, store.holders(asked.select("print").distinct()))
        known = cut(_first(_verify(pairs, store)).select("id", "other"))
        shared, picked = shared.join(known, "id", "left_anti"), picked.join(known, "id", "left_anti")
    # Among the batch's own texts, those left.
    inner = _resolve(_within(shared.where("own > 1"), picked.drop("held"), store))
    found = cut(inner if known is None else inner.unionByName(known))
    followed = copies.join(found.select(F.col("id").alias("lead"), "other"), "lead", "left").select("id", F.coalesce("other", "lead").alias("other"))
    result = cut(found.unionByName(followed))
    store.add(reps.join(found, "id", "left_anti"), span[1])
    return result


def _let_go(spark: SparkSession) -> None:
    """Lets the driver notice that a batch's shuffles and checkpoints are no longer referred to, so that their files go before the next batch."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def deduplicate(docs: DataFrame, steps: list[float] = (0.1, 0.4), store_path: str | None = None) -> DataFrame:
    """All duplicates of docs (id, at, text) in the order of (at, id): the first part is taken in as a bulk, then each later part as a batch against the store."""
    spark = docs.sparkSession
    docs = docs.where("at is not null")
    cuts = docs.stat.approxQuantile("at", list(steps), 0.001) if steps else []
    edges = sorted(set(cuts))
    path = store_path or scratch(spark, "fingerprints")
    store = FingerprintStore(spark, path)
    out = None
    for lo, hi in zip([None, *edges], [*edges, None]):
        part = docs if lo is None else docs.where(F.col("at") > lo)
        part = part if hi is None else part.where(F.col("at") <= hi)
        found = ingest(part, store)
        out = found if out is None else out.unionByName(found)
        _let_go(spark)
    if store_path is None:
        remove(spark, path)
    return out


def batched(spark: SparkSession, folder: str) -> DataFrame:
    """Analyses that belong to a batch, with the batch's start. A batch saved twice has one start; one of unknown start has no place in the order and is left out."""
    starts = table(spark, folder, "batches").groupBy("id").agg(F.min("started_at").alias("at")).where("id is not null and at is not null")
    return spread(table(spark, folder, "analyses").select("id", "batch_id", F.col("original_text").alias("text")).where("batch_id is not null")).join(starts.withColumnRenamed("id", "batch_id"), "batch_id").select("id", "at", "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate(batched(spark, folder)).select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
