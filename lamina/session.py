"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lamina-")) / "lamina_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, else, on one machine alone (tests), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.lamina.shared", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lamina-shared-")
        spark.conf.set("spark.lamina.shared", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder; a lost executor costs nothing already written."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that scratch() named."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row: what the shuffle setting says, at least one for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _moves_rows(plan) -> bool:
    """Whether a node of a physical plan puts rows elsewhere or ends a stage: its name is looked at, not what it says of tables and columns."""
    name, children = plan.nodeName(), plan.children()
    return any(w in name for w in ("Exchange", "Join", "Aggregate", "Sort", "Window", "Limit", "TakeOrdered")) or any(_moves_rows(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row, over a scan that gives fewer partitions than there are cores (a few small files):
    the rows dealt out to all cores. A scan with enough partitions, the usual case at scale, and anything behind a shuffle stay as they are."""
    execution = df._jdf.queryExecution()
    if _moves_rows(execution.sparkPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
