"""Scripts as documents: binary files, archives, pasted text; decoding by byte-order marks."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.text import extension_allowed, file_name
from lamina.session import ship

LIMIT_FILES, LIMIT_BYTES, LIMIT_TOTAL = 200, 5_000_000, 100_000_000


def decode_bytes(raw: bytes | None) -> str | None:
    """UTF-8, UTF-16 or UTF-32 by their marks; UTF-16 without a mark by zeros on one side; else UTF-8, with replacement."""
    if raw is None:
        return None
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace")
    if len(raw) >= 4 and len(raw) % 2 == 0:
        head = raw[:4096]
        zeros = [head[k::2].count(0) / (len(head) // 2) for k in (0, 1)]
        if min(zeros) < 0.05 and max(zeros) > 0.4:
            return raw.decode("utf-16-le" if zeros[1] > zeros[0] else "utf-16-be", "replace")
    return raw.decode("utf-8", "replace")


def _decode(raw: Column) -> Column:
    return F.pandas_udf(lambda part: part.map(decode_bytes, na_action="ignore"), "string")(raw)


def decoded(content: Column) -> Column:
    """Text of a BINARY column. Plain ASCII, the common case, never leaves the JVM."""
    plain = F.decode(content, "ISO-8859-1")
    ascii_ = plain.rlike(r"^[\x01-\x7F]*\z")
    return F.when(ascii_, plain).otherwise(_decode(content))


def read_scripts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, filename, source_kind, content, text of the allowed files below a path; one document a file, none split."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(extension_allowed(name)).select("path", file_name(name).alias("filename"), F.lit("file").alias("source_kind"), "content", decoded(F.col("content")).alias("text"))


def pasted(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("pasted", text)], "source_kind string, text string")


def members(raw: bytes | None, room: int = LIMIT_FILES, budget: int = LIMIT_TOTAL) -> list[tuple[str, str | None, str | None]]:
    """(name, text, skip_reason) of an archive's files: flattened, sane names, sizes checked while reading, never by what is declared."""
    out: list[tuple[str, str | None, str | None]] = []
    try:
        z = zipfile.ZipFile(io.BytesIO(raw or b""))
    except (zipfile.BadZipFile, OSError, ValueError):
        return [("", None, "not an archive")]
    taken = used = 0
    for info in z.infolist():
        name = info.filename.replace("\\", "/").rsplit("/", 1)[-1]
        if info.is_dir() or not name:
            continue
        if taken >= room:
            out.append((name, None, "count"))
            break
        if not name.lower().rsplit(".", 1)[-1] in ("ps1", "txt", "vbs", "js", "bat", "cmd", "log") or "." not in name:
            out.append((name, None, "type"))
            continue
        try:
            with z.open(info) as f:
                data = f.read(LIMIT_BYTES + 1)
        except Exception:  # noqa: BLE001 - whatever a hostile archive raises, it is skipped
            out.append((name, None, "unreadable"))
            continue
        if len(data) > LIMIT_BYTES or not data:
            out.append((name, None, "size" if data else "empty"))
            continue
        if used + len(data) > budget:
            out.append((name, None, "budget"))
            break
        taken, used = taken + 1, used + len(data)
        out.append((name, decode_bytes(data), None))
    return out


def _members(raw: Column) -> Column:
    return F.pandas_udf(lambda part: part.map(lambda r: [{"name": a, "text": b, "skip_reason": c} for a, b, c in members(r)]), "array<struct<name:string,text:string,skip_reason:string>>")(raw)


def unzipped(archives: DataFrame, content: str) -> DataFrame:
    """The rows of archives by their members: name, text, skip_reason."""
    ship(archives.sparkSession)
    return archives.withColumn("_m", F.explode(_members(F.col(content)))).select(*[c for c in archives.columns if c != content], "_m.*")
