"""What a job needs of the cluster: this package on the Python workers, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_sent: set[str] = set()
_own_folder: dict[str, str] = {}


def python_ready(spark: SparkSession) -> None:
    """Sends this package to the Python workers, however the driver found it."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _sent or not package.is_dir():
        return
    archive = f"{tempfile.mkdtemp(prefix='recordloom-')}/recordloom-files.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    _sent.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without that setting a folder of this process, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='recordloom-')}"
    return _own_folder[context.applicationId]


class Steps:
    """Tables between the steps of a job, written to the shared folder: lineage and plans stay short, a lost executor
    costs one step, and no step is computed twice. `drop` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/recordloom/{spark.sparkContext.applicationId}/job-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key is common from a HOT-th of all rows on, and from LEAST rows.
HOT, LEAST = 1000, 2000


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined with facts by the columns `on`. facts is a stored table with one row for each key of rows and, in `n`,
    how many rows have it. Keys with more than a HOT-th of all rows, of which there are at most HOT, are broadcast, so
    that no task gets all rows of a common key; the others are shuffled."""
    limit = max((facts.agg(F.sum(n)).first()[0] or 0) // HOT, LEAST)
    hot = facts.filter(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(facts, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.filter(F.col(n) <= limit), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
