"""Long exact spans shared between records (problem 2).

Method: repeated-phrase automata. Every stretch of SPAN characters holds a
phrase that winnowing selects in whatever text the stretch stands. Phrases
that recur in another record are confirmed, compiled into Aho-Corasick
automata, sharded by the documents that hold them, and the documents are
streamed through to locate every occurrence. Around the occurrences, hashes of
whole SPAN-character windows tell what is shared; no pair of records is formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.session import cut, remove, scratch, ship, spread, table

PHRASE = 40
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
#: Texts whose phrases share an automaton; bounds its memory.
SHARD = 256


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(cp: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the window of `length` characters at each position, by doubling."""
    if len(cp) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        cur = cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        cur ^= cur >> np.uint64(29)
        acc, have, size, left = None, 0, 1, length
        while left:
            if left & 1:
                if acc is None:
                    acc = cur
                else:
                    n = min(len(acc), len(cur) - have)
                    acc = acc[:n] + np.uint64(pow(_BASE, have, 1 << 64)) * cur[have : have + n]
                have += size
            left >>= 1
            if left:
                cur = cur[: len(cur) - size] + np.uint64(pow(_BASE, size, 1 << 64)) * cur[size:]
                size *= 2
        acc = acc[: len(cp) - length + 1] + np.uint64(length)
        acc = (acc ^ (acc >> np.uint64(31))) * np.uint64(0xA0761D6478BD642F)
        return acc ^ (acc >> np.uint64(29))


def selected(cp: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the phrases that winnowing selects: the least of each span - PHRASE + 1 neighbours, the first of equals."""
    h = windows(cp, PHRASE)
    n = span - PHRASE + 1
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Sliding minimum by blocks: suffix minima of one block and prefix minima of the next.
    pad = -len(h) % n
    x = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, n)
    front, back = np.minimum.accumulate(x, axis=1).ravel(), np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: len(h) - n + 1], front[n - 1 : len(h)])
    at = np.nonzero(np.isin(h, np.unique(least)))[0]
    return at, h[at]


def _anchors(span: int):
    def run(batches):
        for b in batches:
            out = [(np.unique(selected(codes(t), span)[1])) for t in b.column(2).to_pylist()]
            sizes = [len(x) for x in out]
            every = np.concatenate(out) if out else np.zeros(0, np.uint64)
            rep = np.repeat(np.arange(b.num_rows), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), b.column(0).take(pa.array(rep)), b.column(1).take(pa.array(rep))], names=["phrase", "id", "field"])

    return run


def grid(at: np.ndarray, span: int, stride: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the whole windows (span) and the narrow ones (span - stride) that are tried around phrases at `at`."""
    room = span - PHRASE
    whole = np.unique((at[:, None] - np.arange(0, room + 1, stride)[None]).ravel())
    narrow = np.unique((at[:, None] - np.arange(0, room - stride + 1, stride)[None]).ravel())
    return whole[(whole >= 0) & (whole <= size - span)], narrow[(narrow >= 0) & (narrow <= size - span + stride)]


def _locate(span: int, stride: int):
    def run(batches):
        import ahocorasick

        for b in batches:
            for start in range(0, b.num_rows, SHARD):
                part = b.slice(start, SHARD)
                texts = part.column(2).to_pylist()
                known = part.column(3)
                automaton, each = ahocorasick.Automaton(), []
                for i, t in enumerate(texts):
                    cp = codes(t)
                    each.append(cp)
                    at, h = selected(cp, span)
                    for p in at[np.isin(h, np.asarray(known[i].values).view(np.uint64))]:
                        automaton.add_word(t[p : p + PHRASE], True)
                if not len(automaton):
                    continue
                automaton.make_automaton()
                hs, rows, starts, kinds = [], [], [], []
                for i, t in enumerate(texts):
                    at = np.fromiter((e - PHRASE + 1 for e, _ in automaton.iter(t)), np.int64)
                    whole, narrow = grid(at, span, stride, len(t))
                    for kind, s, n in ((0, whole, span), (1, narrow, span - stride)):
                        if len(s):
                            hs.append(windows(each[i], n)[s])
                            starts.append(s)
                            rows.append(np.full(len(s), i))
                            kinds.append(np.full(len(s), kind, np.int8))
                if not hs:
                    continue
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(kinds))], names=["h", "id", "field", "start", "kind"]
                )

    return run


def _fine(span: int, stride: int):
    """All whole windows that a narrow window may be part of."""

    def run(batches):
        for b in batches:
            hs, rows, starts = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                at = np.asarray(b.column(3)[i].values).astype(np.int64)
                s = np.unique((at[:, None] - np.arange(0, stride + 1)[None]).ravel())
                s = s[(s >= 0) & (s <= len(t) - span)]
                if len(s):
                    hs.append(windows(codes(t), span)[s])
                    starts.append(s)
                    rows.append(np.full(len(s), i))
            if hs:
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(starts).astype(np.int32))], names=["h", "id", "field", "start"])

    return run


def _elsewhere(rows: DataFrame, key: str) -> DataFrame:
    """The keys that stand under at least two ids; partial minima and maxima, whatever the size of a key's group."""
    return rows.groupBy(key).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select(key)


def texts_of(df: DataFrame, key: str, fields: list[str], span: int) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("field"), F.col(f).alias("text")) for i, f in enumerate(fields))))
    return spread(df.select(key, *fields)).select(F.col(key).cast("long").alias("id"), each.alias("t")).select("id", "t.field", "t.text").where((F.length("text") >= span) & F.col("id").isNotNull())


class Shared:
    """Windows of `span` characters that records of a table share with records of another id. stride: spacing of the windows tried around a phrase."""

    def __init__(self, df: DataFrame, key: str, fields: list[str], span: int = 200, stride: int = 40):
        if not PHRASE + stride <= span:
            raise ValueError(f"spans must be of at least {PHRASE + stride} characters")
        self.spark = df.sparkSession
        ship(self.spark)
        self.span, self.stride, self.fields = span, stride, fields
        self.texts = texts_of(df, key, fields, span)
        self.folder = scratch(self.spark, "passages")
        self.texts.mapInArrow(_anchors(span), "phrase long, id long, field byte").write.parquet(f"{self.folder}/phrases")
        phrases = self.spark.read.parquet(f"{self.folder}/phrases")
        held = phrases.join(_elsewhere(phrases, "phrase"), "phrase").groupBy("id", "field").agg(F.collect_set("phrase").alias("phrases"))
        routed = self.texts.join(held, ["id", "field"]).select("id", "field", "text", "phrases")
        routed.mapInArrow(_locate(span, stride), "h long, id long, field byte, start int, kind byte").write.parquet(f"{self.folder}/windows")
        self.windows = self.spark.read.parquet(f"{self.folder}/windows")
        self.matched = cut(self.windows.join(_elsewhere(self.windows, "h"), "h"))

    def found(self) -> DataFrame:
        """(id, field) of each text with a shared span; exact for every length from span up."""
        sure = cut(self.matched.where("kind = 0").select("id", "field").distinct())
        # A shared narrow window and no shared whole one: the span is shorter than span + stride, or none. All its windows are tried.
        narrow = self.matched.where("kind = 1")
        asked = narrow.join(sure, ["id", "field"], "left_anti").select("h").distinct()
        more = self._tried(asked).select("id", "field").distinct()
        return cut(sure.unionByName(more.join(sure, ["id", "field"], "left_anti")))

    def _tried(self, asked: DataFrame) -> DataFrame:
        """(id, field, start) of the whole windows around the asked narrow ones, in all texts that have these, that stand under another id too."""
        narrow = self.matched.where("kind = 1")
        near = narrow.join(asked, "h", "left_semi").groupBy("id", "field").agg(F.collect_set("start").alias("starts"))
        fine = cut(self.texts.join(near, ["id", "field"]).select("id", "field", "text", "starts").mapInArrow(_fine(self.span, self.stride), "h long, id long, field byte, start int"))
        return fine.join(_elsewhere(fine, "h"), "h", "left_semi").select("id", "field", "start")

    def coverage(self) -> DataFrame:
        """(id, field, shared_chars, spans): characters that shared windows cover, and in how many stretches. Exact: within a shared stretch the
        narrow windows tried follow each other closely, so where they break off is an end, and there all whole windows are tried."""
        beside = Window.partitionBy("id", "field").orderBy("start")
        gap = self.stride + 1
        ends = (
            self.matched.where("kind = 1").withColumn("before", F.col("start") - F.lag("start").over(beside)).withColumn("after", F.lead("start").over(beside) - F.col("start"))
            .where((F.coalesce("before", F.lit(gap + 1)) > gap) | (F.coalesce("after", F.lit(gap + 1)) > gap)).select("h").distinct()
        )
        found = self.matched.where("kind = 0").select("id", "field", "start").unionByName(self._tried(ends))
        starts = found.groupBy("id", "field").agg(F.array_sort(F.collect_set("start")).alias("s"))
        span = self.span
        step = F.aggregate(
            "s",
            F.struct(F.lit(0).alias("chars"), F.lit(0).alias("spans"), F.lit(-1).alias("end")),
            lambda a, x: F.struct(
                (a["chars"] + F.least(F.lit(span), x + span - a["end"])).cast("int").alias("chars"),
                F.when(x > a["end"], a["spans"] + 1).otherwise(a["spans"]).alias("spans"),
                (x + span).cast("int").alias("end"),
            ),
        )
        return starts.select("id", "field", step.alias("r")).select("id", "field", F.col("r.chars").alias("shared_chars"), F.col("r.spans").alias("spans"))

    def close(self) -> None:
        remove(self.spark, self.folder)


def shared_fields(df: DataFrame, key: str, fields: list[str], span: int = 200) -> DataFrame:
    """(key, field) of each text that holds a span of at least `span` characters found verbatim in any field under another key.

    Nulls and texts shorter than the span hold none; a null key takes no part;
    what stands twice under one key (in two fields, or in a row given twice)
    isn't shared by that; texts are read whole; an empty table gives no rows.
    """
    s = Shared(df, key, fields, span)
    out = s.found()
    s.close()
    name = F.element_at(F.array(*(F.lit(f) for f in fields)), F.col("field").cast("int") + 1)
    return out.select(F.col("id").alias(key), name.alias("field"))


def shared_amount(df: DataFrame, key: str, fields: list[str], span: int = 200) -> DataFrame:
    """For every record and field: chars, shared_chars (in spans of at least `span` found elsewhere), share and spans. Cases as in shared_fields(); a null or empty text has 0 of 0 characters."""
    s = Shared(df, key, fields, span)
    parts = cut(s.coverage())
    s.close()
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("field"), F.lit(f).alias("name"), F.coalesce(F.length(f), F.lit(0)).alias("chars")) for i, f in enumerate(fields))))
    every = df.select(F.col(key).cast("long").alias("id"), each.alias("t")).select("id", "t.*")
    zero = F.lit(0)
    return every.join(parts, ["id", "field"], "left").select(
        F.col("id").alias(key), F.col("name").alias("field"), "chars", F.coalesce("shared_chars", zero).alias("shared_chars"), F.when(F.col("chars") > 0, F.coalesce("shared_chars", zero) / F.col("chars")).otherwise(0.0).alias("share"), F.coalesce("spans", zero).alias("spans")
    )


FIELDS = ["original_text", "deobfuscated_text"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_fields(table(spark, folder, "analyses").select("id", *FIELDS), "id", FIELDS).withColumnRenamed("id", "analysis_id")


def p2_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_amount(table(spark, folder, "analyses").select("id", *FIELDS), "id", FIELDS).withColumnRenamed("id", "analysis_id")


QUERIES = {"p2_found": p2_found, "p2_shared": p2_shared}
SQL: dict[str, str] = {}
