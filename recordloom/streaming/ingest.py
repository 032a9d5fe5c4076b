"""An extension: files that arrive in a folder are ingested once each, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans import incremental
from recordloom.plans.contract import Contract
from recordloom.sources import files
from recordloom.sources.versioned import Store


def arriving_cells(spark: SparkSession, folder: str, checkpoint: str, root: str, then: Callable[[DataFrame, int], None] | None = None, max_rows: int = files.MAX_ROWS):
    """Reads what is new in folder, writes its cells to root by file, and calls `then` on each batch of cells.

    A batch is written by replacing its files' partitions, so a batch that runs again leaves the same cells."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrivals = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{csv,xlsx,CSV,XLSX}").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        cells = files.cell_rows(files.parse(df.select("path", "content"), max_rows))
        if not cells.isEmpty():
            files.ingest(cells, root)
            if then:
                then(cells.withColumn("batch", F.lit(number)), number)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_records(spark: SparkSession, folder: str, checkpoint: str, store: Store, contract: Contract, reference_date: str, max_rows: int = files.MAX_ROWS):
    """Keeps a store's records up to date with the files that arrive in folder: each batch is one version, in which only the
    entities that its files touch are computed anew (see `incremental.update`). A batch that runs again after a restart
    changes no snapshot and adds nothing to the history."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrivals = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{csv,xlsx,CSV,XLSX}").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        cells = files.cell_rows(files.parse(df.select("path", "content"), max_rows)).drop("raw_type")
        if not cells.isEmpty():
            incremental.update(store, contract, reference_date, cells)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
