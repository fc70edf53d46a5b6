"""Consensus from several annotators' labels (problem 3).

Method: bipartite message passing on the label edges, one class against the
rest. An annotator sends each of its items how much its label speaks for the
class, judged by all its other labels; an item sends each of its annotators how
probable the class is by all its other labels; this goes on to convergence.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from lamina.session import cut, remove, scratch, ship, table

CLASSES = ("malicious", "suspicious", "clean")
#: Pseudo-counts that hold a rarely seen annotator near chance, and the bound of a belief.
PRIOR, EDGE = 2.0, 1e-3
#: Annotators up to which their sums go to every task (about a megabyte).
FEW = 10_000


def opinions(intel: DataFrame, classes=CLASSES) -> DataFrame:
    """Distinct edges (item, annotator, label); what is no opinion is left out."""
    label = F.lower(F.regexp_replace("verdict", r"^\s+|\s+$", ""))
    return (
        intel.select(F.col("finding_id").alias("item"), F.col("source").alias("annotator"), label.alias("label"))
        .where(F.col("label").isin(*classes) & F.col("item").isNotNull() & F.col("annotator").isNotNull())
        .groupBy("item", "annotator").agg(F.min("label").alias("label"))
    )


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _values(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a list or binary column one after the other, and how many each row has."""
    if pa.types.is_list(column.type):
        return np.asarray(column.flatten()).astype(dtype), np.diff(np.asarray(column.offsets))
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype), np.diff(ends) // np.dtype(dtype).itemsize


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of rows of numbers: the JVM passes them on without looking at each."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * values.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _numbers(k: int, size: int, base: list[float], totals: dict | None, kind):
    """One round over items in rows (item, code, said, x, t): new messages of each edge, the item's support t, and in a last row the sums of
    the task by annotator. totals: what all edges of each annotator come to; None for the start."""
    schema = pa.schema([("item", kind), *((c, pa.binary()) for c in ("code", "said", "x", "t")), ("at", pa.list_(pa.int32())), ("sums", pa.list_(pa.float64()))])
    prior, base_ = np.log(np.array(base) / (1 - np.array(base))), np.array(base)

    def run(batches):
        sums = np.zeros(1 + 2 * size * k)
        for b in batches:
            if not b.num_rows:
                continue
            (code, lengths), (said, _) = _values(b.column(1), np.int32), _values(b.column(2), np.int8)
            row, starts = np.repeat(np.arange(b.num_rows), lengths), np.concatenate([[0], np.cumsum(lengths)[:-1]])
            own = said[:, None] == np.arange(k)[None]
            if totals is None:
                t = np.add.reduceat(own.astype(float), starts)
                new = (t[row] - own + base_) / lengths[row][:, None]
            else:
                x = _values(b.column(3), np.float64)[0].reshape(-1, k)
                others, labelled = totals["n"][code][:, None] - 1, totals["l"][code] - own
                yes = totals["n1"][code] - x
                hit = totals["s1"][code] - x * own
                rate = (labelled + PRIOR * base_) / (others + PRIOR)
                sens = np.clip((hit + PRIOR * rate) / (yes + PRIOR), EDGE, 1 - EDGE)
                fall = np.clip((labelled - hit + PRIOR * rate) / (others - yes + PRIOR), EDGE, 1 - EDGE)
                message = np.where(own, np.log(sens / fall), np.log((1 - sens) / (1 - fall)))
                t = np.add.reduceat(message, starts) + prior
                # An item belongs to one class: the beliefs of its one-against-rest messages are brought to a sum of one.
                new = 1 / (1 + np.exp(-np.clip(t[row] - message, -30, 30)))
                new /= new.sum(axis=1, keepdims=True)
                sums[0] += np.abs(new - x).sum()
            for i in range(k):
                sums[1 + i * size : 1 + (i + 1) * size] += np.bincount(code, new[:, i], size)
                sums[1 + (k + i) * size : 1 + (k + i + 1) * size] += np.bincount(code, new[:, i] * own[:, i], size)
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(code, lengths), _packed(said, lengths), _packed(new, lengths * k), _packed(t, np.full(b.num_rows, k)), none.cast(schema.field("at").type), none.cast(schema.field("sums").type)], schema=schema)
        there = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.nulls(1).cast(f.type) for f in list(schema)[:5]] + [pa.array([there], pa.list_(pa.int32())), pa.array([sums[there]], pa.list_(pa.float64()))], schema=schema)

    return run


def _decided(k: int, classes, kind):
    def run(batches):
        for b in batches:
            (said, lengths), t = _values(b.column(1), np.int8), _values(b.column(2), np.float64)[0].reshape(-1, k)
            best = t.argmax(axis=1)
            agree = np.bincount(np.repeat(np.arange(b.num_rows), lengths), said == np.repeat(best, lengths), b.num_rows) / np.maximum(lengths, 1)
            belief = 1 / (1 + np.exp(-np.clip(t, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(classes, dtype=object)[best], pa.string()), pa.array(lengths.astype(np.int64)), pa.array(agree), pa.array(belief.max(axis=1) / belief.sum(axis=1))],
                schema=pa.schema([("item", kind), ("verdict", pa.string()), ("opinions", pa.int64()), ("agreement", pa.float64()), ("confidence", pa.float64())]),
            )

    return run


def consensus(edges: DataFrame, classes=CLASSES, tolerance: float = 1e-3, most: int = 200, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) of edges (item, annotator, label) that are distinct by item and annotator.

    items: item, verdict, opinions, agreement (share of its annotators that
    gave the verdict), confidence. annotators: annotator, opinions, reliability
    (expected share of right labels), for each class its sensitivity and
    specificity, and of the run the rounds and whether it converged: whether
    the mean change of a message fell below `tolerance`. Equal support goes to
    the class named first in `classes`. An item with one label gets that label
    unless its annotator is worthless; a single annotator counts as right above
    chance. No edges give no rows; null items, annotators and other labels are
    left out.

    Edges are shuffled once, to lie by item; a round is then one pass over the
    items, and of it only sums by annotator travel. Of more than `few`
    annotators the sums aren't sent to every task but joined.
    """
    spark, k = edges.sparkSession, len(classes)
    edges = edges.where(F.col("label").isin(*classes) & F.col("item").isNotNull() & F.col("annotator").isNotNull())
    tally = edges.groupBy("annotator").agg(*(F.count_if(F.col("label") == c).alias(f"l{i}") for i, c in enumerate(classes))).limit(few + 1).collect()
    if len(tally) > few:
        return _wide(edges, classes, tolerance, most)
    tally.sort(key=lambda r: r["annotator"])
    size = len(tally)
    l = np.array([[r[f"l{i}"] for i in range(k)] for r in tally], dtype=float).reshape(size, k)
    every = l.sum()
    base = [max(EDGE, min(1 - EDGE, v)) for v in (l.sum(axis=0) / every if every else np.full(k, 1 / k))]
    ship(spark)
    codes = spark.createDataFrame([(r["annotator"], i) for i, r in enumerate(tally)], StructType([StructField("annotator", edges.schema["annotator"].dataType), StructField("code", IntegerType())]))
    said = F.coalesce(*(F.when(F.col("label") == c, F.lit(i)) for i, c in enumerate(classes))).cast("byte")
    # An item has an edge for each annotator at most, so its row is bounded by `few`.
    graph = edges.join(F.broadcast(codes), "annotator").groupBy("item").agg(F.collect_list(F.struct("code", said.alias("said"))).alias("e")).select("item", F.col("e.code").alias("code"), F.col("e.said").alias("said"))
    kind = edges.schema["item"].dataType
    columns = f"item {kind.simpleString()}, code binary, said binary, x binary, t binary, at array<int>, sums array<double>"
    folder = scratch(spark, "consensus")

    def turn(rows: DataFrame, n: int, totals: dict | None) -> tuple[DataFrame, dict, float]:
        out = rows.mapInArrow(_numbers(k, size, base, totals, to_arrow_type(kind)), columns)
        out.withColumn("last", F.col("item").isNull()).write.partitionBy("last").parquet(f"{folder}/{n}")
        state = spark.read.schema(columns + ", last boolean").parquet(f"{folder}/{n}")
        sums = np.zeros(1 + 2 * size * k)
        for at, v in state.where("last").select(F.explode(F.arrays_zip("at", "sums")).alias("p")).groupBy("p.at").agg(F.sum("p.sums")).collect():
            sums[at] = v
        n1, s1 = (sums[1 + j * k * size : 1 + (j + 1) * k * size].reshape(k, size).T for j in range(2))
        return state.where("not last").drop("last"), {"n": l.sum(axis=1), "l": l, "n1": n1, "s1": s1}, sums[0]

    state, totals, _ = turn(graph, 0, None)
    n, change = 0, 0.0
    while every and n < most:
        n += 1
        state, totals, moved = turn(state, n, totals)
        remove(spark, f"{folder}/{n - 1}")
        change = moved / (every * k)
        if change < tolerance:
            break
    items = state.select("item", "said", "t").mapInArrow(_decided(k, classes, to_arrow_type(kind)), f"item {kind.simpleString()}, verdict string, opinions long, agreement double, confidence double")
    with np.errstate(invalid="ignore", divide="ignore"):
        sens, spec = totals["s1"] / totals["n1"], 1 - (l - totals["s1"]) / (l.sum(axis=1)[:, None] - totals["n1"])
    figures = [(r["annotator"], int(l[a].sum()), float(totals["s1"][a].sum() / l[a].sum()), *(float(v) for v in sens[a]), *(float(v) for v in spec[a]), n, bool(change < tolerance)) for a, r in enumerate(tally)]
    columns = [*(StructField(x, DoubleType()) for x in ("reliability", *(f"sensitivity_{c}" for c in classes), *(f"specificity_{c}" for c in classes)))]
    return items, spark.createDataFrame(figures, StructType([codes.schema["annotator"], StructField("opinions", LongType()), *columns, StructField("rounds", IntegerType()), StructField("converged", BooleanType())]))


def _wide(edges: DataFrame, classes, tolerance: float, most: int) -> tuple[DataFrame, DataFrame]:
    """consensus() where annotators are too many for one table: the messages go over joins, partitioned by item and by annotator in turn."""
    k = len(classes)
    said = [F.when(F.col("label") == c, 1.0).otherwise(0.0) for c in classes]
    # Start: the share of each class among an item's labels, leaving out the edge's own (the class shares of all edges stand in where none is left).
    share = edges.agg(*(F.avg(s).alias(f"b{i}") for i, s in enumerate(said))).first()
    base = [max(EDGE, min(1 - EDGE, v if v is not None else 1 / k)) for v in share]
    votes = edges.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(f"v{i}") for i, s in enumerate(said)))
    state = cut(edges.join(votes, "item").select("item", "annotator", "label", *(((F.col(f"v{i}") - said[i] + base[i]) / F.col("n")).alias(f"x{i}") for i in range(k))))
    turn, change = 0, 0.0
    for turn in range(1, most + 1):
        # Annotator side: expected hits by class. n1/n0: items that are / are not of the class; s1/s0: those it labelled with the class.
        totals = state.groupBy("annotator").agg(
            F.count(F.lit(1)).alias("n"),
            *(F.sum(f"x{i}").alias(f"n{i}") for i in range(k)),
            *(F.sum(said[i]).alias(f"l{i}") for i in range(k)),
            *(F.sum(F.col(f"x{i}") * said[i]).alias(f"s{i}") for i in range(k)),
        )
        joined = state.join(totals, "annotator")
        message = []
        for i in range(k):
            x, own = F.col(f"x{i}"), said[i]
            yes, no = F.col(f"n{i}") - x, (F.col("n") - 1) - (F.col(f"n{i}") - x)
            hit, false = F.col(f"s{i}") - x * own, (F.col(f"l{i}") - own) - (F.col(f"s{i}") - x * own)
            rate = (F.col(f"l{i}") - own + PRIOR * base[i]) / (F.col("n") - 1 + PRIOR)
            sens, fall = (hit + PRIOR * rate) / (yes + PRIOR), (false + PRIOR * rate) / (no + PRIOR)
            sens, fall = F.greatest(F.least(sens, F.lit(1 - EDGE)), F.lit(EDGE)), F.greatest(F.least(fall, F.lit(1 - EDGE)), F.lit(EDGE))
            message.append(F.when(own == 1.0, F.log(sens / fall)).otherwise(F.log((1 - sens) / (1 - fall))).alias(f"m{i}"))
        sent = joined.select("item", "annotator", "label", *message)
        support = sent.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"m{i}").alias(f"t{i}") for i in range(k)))
        prior = [F.log(F.lit(b / (1 - b))) for b in base]
        back = sent.join(support, "item")
        # An item belongs to one class: the beliefs of its one-against-rest messages are brought to a sum of one.
        odds = [F.exp(F.greatest(F.least(F.col(f"t{i}") - F.col(f"m{i}") + prior[i], F.lit(30.0)), F.lit(-30.0))) for i in range(k)]
        belief = [o / (1 + o) for o in odds]
        turned = cut(back.join(state.select("item", "annotator", *(F.col(f"x{i}").alias(f"o{i}") for i in range(k))), ["item", "annotator"]).select("item", "annotator", "label", *((b / _sum(belief)).alias(f"x{i}") for i, b in enumerate(belief)), *(F.col(f"o{i}") for i in range(k))))
        change = turned.agg(F.avg(_sum([F.abs(F.col(f"x{i}") - F.col(f"o{i}")) for i in range(k)]))).first()[0] or 0.0
        state = turned.drop(*(f"o{i}" for i in range(k)))
        if change / k < tolerance:
            break
    final = support.select("item", F.col("n").alias("opinions"), *((F.col(f"t{i}") + prior[i]).alias(f"t{i}") for i in range(k)))
    best = F.greatest(*(F.col(f"t{i}") for i in range(k)))
    verdict = F.coalesce(*(F.when(F.col(f"t{i}") == best, F.lit(c)) for i, c in enumerate(classes)))
    odds = [F.exp(F.greatest(F.least(F.col(f"t{i}"), F.lit(30.0)), F.lit(-30.0))) for i in range(k)]
    belief = [o / (1 + o) for o in odds]
    decided = cut(final.select("item", "opinions", verdict.alias("verdict"), (F.greatest(*belief) / _sum(belief)).alias("confidence")))
    told = edges.join(decided.select("item", "verdict"), "item")
    items = told.groupBy("item").agg(F.avg((F.col("label") == F.col("verdict")).cast("double")).alias("agreement")).join(decided, "item").select("item", "verdict", "opinions", "agreement", "confidence")
    expected = F.coalesce(*(F.when(F.col("label") == c, F.col(f"x{i}")) for i, c in enumerate(classes)))
    annotators = state.groupBy("annotator").agg(
        F.count(F.lit(1)).alias("opinions"),
        F.avg(expected).alias("reliability"),
        *((F.sum(F.col(f"x{i}") * said[i]) / F.sum(f"x{i}")).alias(f"sensitivity_{c}") for i, c in enumerate(classes)),
        *((1 - F.sum((1 - F.col(f"x{i}")) * said[i]) / F.sum(1 - F.col(f"x{i}"))).alias(f"specificity_{c}") for i, c in enumerate(classes)),
    )
    return items, annotators.withColumns({"rounds": F.lit(turn), "converged": F.lit(change / k < tolerance)})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = consensus(opinions(table(spark, folder, "finding_intel")))
    return items.where("opinions >= 3").select(F.col("item").alias("finding_id"), "verdict")


def p3_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = consensus(opinions(table(spark, folder, "finding_intel")))
    return items.withColumnRenamed("item", "finding_id")


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    _, annotators = consensus(opinions(table(spark, folder, "finding_intel")))
    return annotators.withColumnRenamed("annotator", "source")


QUERIES = {"p3_found": p3_found, "p3_verdicts": p3_verdicts, "p3_sources": p3_sources}
SQL: dict[str, str] = {}
