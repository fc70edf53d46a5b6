"""Layers of scripts as a table, and which layer a finding belongs to.

The kernel runs once for each different text: equal texts are found by their
hash before any Python is reached, and the result is joined back. A document's
own budgets (levels, layers, bytes) are sequential inside it, so it is one unit
of work; documents are independent.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import refang
from lamina.operators.findings import first_of_equals, scan, without_pieces
from lamina.operators.surveys import masked_text
from lamina.session import cut, ship, spread

LAYER = "layer_id int, parent_id int, depth int, path string, language string, edge string, detail string, content string, final string, sha256 string, rounds int, converged boolean, variables map<string,string>, rules array<string>, limits array<string>, refused array<string>, error string"


def _layers(batches, most: int = 64_000_000):
    from lamina.kernel import layers as K

    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 7, pa.int32(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
    names = ["mark", *(f.strip().split(" ")[0] for f in LAYER.replace("map<string,string>", "map").split(","))]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names=names)

    for b in batches:
        for at in range(0, b.num_rows, 64):
            part, out, held = b.slice(at, 64), [], 0
            for mark, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                try:
                    r = K.analyse(text)
                    for x in r.layers:
                        safe = [v.encode("utf-8", "replace").decode() for v in (x.content, x.final)]
                        out.append((mark, x.id, x.parent, x.depth, r.path(x), x.language, x.edge, x.detail, *safe, x.sha256, x.rounds, x.converged, [(k, v.encode("utf-8", "replace").decode()) for k, v in x.variables.items()], [c.rule for c in x.changes], r.limits, x.refused, None))
                        held += len(x.content) + len(x.final)
                        if held > most:  # stages of many MB don't pile up
                            yield batch(out)
                            out, held = [], 0
                except Exception as e:  # noqa: BLE001 - one document's failure is a row, never a failed task
                    out.append((mark, 1, None, 0, "1", "unknown", None, None, text, text, None, 0, False, [], [], [], [], type(e).__name__))
            yield batch(out)


def layers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, layer_id, parent_id, depth, path, language, edge, detail, content, final, ...) for each layer of each text.

    A null text has one empty layer; a document that the kernel fails on has one layer, its text unchanged, and the failure's name in `error`.
    """
    ship(df.sparkSession)
    marked = spread(df.select(key, text)).select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("mark", F.sha2("_t", 256))
    different = marked.groupBy("mark").agg(F.first("_t").alias("_t"))
    found = different.mapInArrow(_layers, "mark string, " + LAYER)
    # Both sides are as many as the documents: what the file's size lets the planner guess of them must never make a broadcast of one.
    return marked.select(key, "mark").join(found.hint("merge"), "mark").drop("mark")


def rewritten(text: Column, language: Column | None = None) -> Column:
    """The rewritten form of one text, without its layers. language: null to let the text decide."""

    def run(texts, languages):
        from lamina.kernel.rewrite import language as guess
        from lamina.kernel.rewrite import rewrite

        return texts.combine(languages, lambda t, lang: None if t is None else rewrite(t, lang or guess(t))[0])

    return F.pandas_udf(run, "string")(text, language if language is not None else F.lit(None).cast("string"))


def language_of(text: Column) -> Column:
    def run(texts):
        from lamina.kernel.rewrite import language

        return texts.map(language, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def evaluated(expression: Column) -> Column:
    """The value of a constant PowerShell expression as text; null where it isn't known."""

    def run(texts):
        from lamina.kernel.psexpr import Stop, evaluate, shown

        def one(t):
            try:
                return shown(evaluate(t))
            except Stop:
                return None

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(expression)


def recipe(text: Column) -> Column:
    """struct(steps, output, score) of the best recipe; null for none."""

    def run(texts):
        import pandas as pd

        from lamina.kernel.decoders import search

        found = [search(t) if t is not None else None for t in texts]
        return pd.DataFrame({"steps": [list(r.steps) if r else None for r in found], "output": [r.output.encode("utf-8", "replace").decode() if r else None for r in found], "score": [r.score if r else None for r in found]})

    return F.pandas_udf(run, "steps array<string>, output string, score double")(text)


def cmd_value(expression: Column) -> Column:
    """set /a of an expression: 32 bits, null where it can't be told."""

    def run(texts):
        from lamina.kernel.batch import Unknown, calculate

        def one(t):
            try:
                return calculate(t, {})
            except Unknown:
                return None

        return texts.map(one).astype("Int32")

    return F.pandas_udf(run, "int")(expression)


def loop_commands(line: Column) -> Column:
    """The commands behind a cmd FOR over constants, as an array; null for other lines."""

    def run(texts):
        from lamina.kernel.batch import loop_values

        return texts.map(lambda t: None if t is None else loop_values(t))

    return F.pandas_udf(run, "array<string>")(line)


def layer_findings(found_layers: DataFrame, key: str) -> DataFrame:
    """Findings of a document's layers, each with the path of the deepest layer whose own text holds it, else of the shallowest that gave it.

    A layer's resolved variables are scanned first, then its final text, then its original one without the ingredients of string operations.
    """
    found_layers = cut(found_layers)  # the kernel runs once, though its result is read twice
    resolved = F.array_join(F.transform(F.map_entries("variables"), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "\n")
    sources = F.array(*(F.struct(F.lit(i).alias("o"), c.alias("t")) for i, c in enumerate((resolved, F.col("final"), masked_text(F.col("content"))))))
    texts = found_layers.select(key, "layer_id", F.explode(sources).alias("s")).select(key, "layer_id", "s.o", "s.t")
    produced = first_of_equals(scan(texts, [key, "layer_id", "o"], "t"), [key, "layer_id"], "o").drop("o")
    at = produced.join(found_layers.select(key, "layer_id", "depth", "path", F.lower("final").alias("_f")), [key, "layer_id"])
    holds = F.contains("_f", F.lower("value")) | F.contains("_f", F.lower(refang(F.col("value"))))
    # Deepest among the holding, shallowest among the others: one order, one partial aggregation.
    order = F.struct(holds.alias("h"), F.when(holds, F.col("depth")).otherwise(-F.col("depth")).alias("d"), F.when(holds, F.col("layer_id")).otherwise(-F.col("layer_id")).alias("i"))
    best = at.groupBy(key, "type", F.lower("value").alias("_l")).agg(F.max_by(F.struct("value", "severity", "mitre", "defanged_value", "path"), order).alias("b")).select(key, "type", "b.*")
    return without_pieces(best, [key])


def tree(found_layers: DataFrame, key: str) -> DataFrame:
    """Figures of each document's tree: layers, greatest depth, rounds, whether all came to rest."""
    return found_layers.groupBy(key).agg(F.count(F.lit(1)).alias("layers"), F.max("depth").alias("depth"), F.sum("rounds").alias("rounds"), F.every("converged").alias("converged"))


def rendered(found_layers: DataFrame, key: str) -> DataFrame:
    """All layers of a document as one text, in their order, a heading before each but the first."""
    block = F.struct("layer_id", F.when(F.col("layer_id") == 1, F.col("final")).otherwise(F.concat(F.lit("==== layer "), F.col("path"), F.lit(" ====\n"), F.col("final"))).alias("t"))
    return found_layers.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["t"]), "\n\n").alias("text"))
