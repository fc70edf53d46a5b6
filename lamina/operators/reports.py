"""What reports are made of: escaped and capped texts, totals, links, orders, settings, and spreadsheets of whole row sets."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable
from urllib.parse import quote
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import values
from lamina.operators.enrich import capabilities

#: The recipe a link opens with: the search itself, four steps deep.
RECIPE = [{"op": "Magic", "args": [4, True, False, ""]}]


def html_escaped(text: Column) -> Column:
    """Markup characters as entities, the ampersand first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def capped(df: DataFrame, text: str, most: int, into: str = "truncated") -> DataFrame:
    """The text up to `most` characters, and whether something was left out; null stays null and isn't truncated."""
    return df.withColumns({text: F.left(text, F.lit(most)), into: F.coalesce(F.length(text) > most, F.lit(False))})


def report_totals(findings: DataFrame, by: list[str]) -> DataFrame:
    """For each group, such as a batch: analyses with findings, findings, and findings of each severity. Partial sums only."""
    return findings.groupBy(*by).agg(F.countDistinct("analysis_id").alias("analyses"), F.count(F.lit(1)).alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in values.SEVERITIES))


def asked_counts(findings: DataFrame) -> DataFrame:
    """For each analysis: findings, those that some provider can be asked about, and addresses to locate."""
    able = sorted({t for types in values.CAPABILITY.values() for t in types})
    return findings.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("type").isin(*able)).alias("queried"), F.countDistinct(F.when(F.col("type") == "ip", F.col("value"))).alias("located"))


def addresses(findings: DataFrame, key: str = "id") -> DataFrame:
    """The different addresses of each analysis, numbered in the order in which they first occur. The window is over one analysis's different addresses."""
    from pyspark.sql import Window

    first = findings.where("type = 'ip' AND value IS NOT NULL").groupBy("analysis_id", "value").agg(F.min(key).alias("_first"))
    return first.select("analysis_id", "value", F.row_number().over(Window.partitionBy("analysis_id").orderBy("_first", "value")).alias("place"))


def chef_link(data: Column, most: int = 200_000, recipe: list[dict] | None = None) -> Column:
    """The fragment with which a public recipe tool opens: the recipe and the data in Base64, both percent-encoded; data of more than `most` bytes stays out."""
    head = "recipe=" + quote(json.dumps(recipe or RECIPE, separators=(",", ":")), safe="")
    raw = F.encode(F.coalesce(data, F.lit("")), "UTF-8")
    coded = F.url_encode(F.regexp_replace(F.base64(raw), "[\r\n]", ""))
    return F.when((F.length(raw) > 0) & (F.length(raw) <= most), F.concat(F.lit(head + "&input="), coded)).otherwise(F.lit(head))


def composed(parts: list[Column], most: int = 320) -> Column:
    """The parts that say something, joined and capped."""
    return F.left(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), ", "), F.lit(most))


def brief(items: Column, most: int) -> Column:
    """The first items of an array and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))


def provider_order(intel: DataFrame, key: str = "finding_id") -> DataFrame:
    """Each finding's sources as one array: answers first, by name, and what wasn't checked last. A finding has few sources; the array is theirs."""
    entry = F.struct(F.coalesce(F.lower(F.trim("verdict")) == "not_checked", F.lit(False)).alias("last"), F.col("source").alias("source"))
    return intel.where("source IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set(entry)).alias("e")).select(key, F.transform("e", lambda e: e["source"]).alias("sources"))


def askable(findings: DataFrame) -> DataFrame:
    """Findings for each provider that can be asked about them."""
    return capabilities(findings).groupBy("provider").agg(F.count(F.lit(1)).alias("findings"))


def upserted(settings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Settings (key, value): a fresh value replaces the one that was there."""
    every = settings.select("key", "value", F.lit(0).alias("o")).unionByName(fresh.select("key", "value", F.lit(1).alias("o")))
    return every.groupBy("key").agg(F.max_by("value", "o").alias("value"))


def key_of(settings: Column, environment: Column) -> Column:
    """A stored key that isn't blank comes before the environment's."""
    return F.coalesce(F.nullif(F.trim(settings), F.lit("")), F.nullif(F.trim(environment), F.lit("")))


def own_variables(mine: Column, inherited: Column) -> Column:
    """The variables a layer made or changed, without those it came with."""
    return F.map_filter(mine, lambda k, v: ~F.coalesce(F.element_at(inherited, k) == v, F.lit(False)))


def workbook(sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """An Office Open XML workbook of text cells: each sheet's first row is its head, frozen and with a filter. Rows are streamed into the archive."""

    def cell(v) -> str:
        text = "" if v is None else "".join(c for c in str(v) if c >= " " or c in "\t\n\r")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    out = io.BytesIO()
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (head, rows) in enumerate(sheets.values(), 1):
            last = ""
            k = len(head)
            while k:
                k, r = divmod(k - 1, 26)
                last = chr(65 + r) + last
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                n = 0
                f.write(("<row>" + "".join(map(cell, head)) + "</row>").encode("utf-8", "replace"))
                for row in rows:
                    n += 1
                    f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode("utf-8", "replace"))
                f.write(f'</sheetData><autoFilter ref="A1:{last}{n + 1}"/></worksheet>'.encode())
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, content): a spreadsheet for each key, such as an analysis, made where its rows are; a sheet is one report's, so its size is the report's."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [workbook({"Findings": (columns, (tuple(r[c] for c in columns) for r in held))}) for held in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=[key, "content"])

    from lamina.session import ship

    ship(rows.sparkSession)
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)))).alias("r"))
    return held.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, content binary")
