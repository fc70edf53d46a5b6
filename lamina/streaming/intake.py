"""Scripts that arrive in a folder, as a stream: decode, scan, append; repeated content is dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.text import extension_allowed, file_name
from lamina.operators.findings import scan
from lamina.session import ship
from lamina.sources.scripts import decoded


def arriving(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """A stream of documents: path, filename, modified, sha256, text."""
    ship(spark)
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_trigger).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.where(extension_allowed(name)).select("path", file_name(name).alias("filename"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), decoded(F.col("content")).alias("text"))


def once(documents: DataFrame, within: str = "1 day") -> DataFrame:
    """Each content once; the state holds the hashes of the watermark's span only."""
    return documents.withWatermark("modified", within).dropDuplicatesWithinWatermark(["sha256"])


def findings_into(documents: DataFrame, table: str, checkpoint: str, once_only: bool = True):
    """Starts the stream: each micro-batch is scanned as a batch and appended; the batch's number makes a repeated write recognisable."""

    def write(batch: DataFrame, number: int) -> None:
        scan(batch, ["path", "sha256"], "text").withColumn("batch_number", F.lit(number)).write.mode("append").parquet(table)

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer.trigger(processingTime="10 seconds")).start()


def rates(events: DataFrame, ts: str, by: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and kind, late ones up to the watermark. Works on a stream and on a table."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("events"))
