"""What the operators share: word rules as Columns, scratch tables in the shared folder, table reading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
#: All ASCII that is neither a digit nor a lower-case letter stands between tokens.
TOKEN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

#: A key is common from a HOT-th of all rows on, and from LEAST rows.
HOT, LEAST = 1000, 2000

_own_folder: dict[str, str] = {}
_sent: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null has none."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def tokens(text: Column) -> Column:
    """The runs of digits, lower-case ASCII letters and non-ASCII characters of a lower-cased text, in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{TOKEN_GAP}+"), "")


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


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's scratch tables."""
    return f"{shared_folder(spark)}/recordloom/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application. Results that were not stored elsewhere are gone, too."""
    delete(spark, scratch_root(spark))


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs one stage and lineage stays short.

    An operator drops what it no longer needs by `keep`; what its result is read from stays until `clear_scratch`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, row_group: int = 128 << 20) -> DataFrame:
        """Writes df, in row groups of about so many bytes, and reads it back."""
        df.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def bucketed(self, df: DataFrame, name: str, n: int, *keys: str) -> DataFrame:
        """Writes df in n buckets of its keys and reads it back: joins by just these keys move the other side only. df comes
        partitioned by them into n parts, so a task writes one file. The catalog forgets the table at once; the files stay."""
        table = f"recordloom_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(n, *keys).saveAsTable(table)
        found = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return found

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for x in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at):
            if x.getPath().getName() not in names:
                delete(self.spark, f"{self.root}/{x.getPath().getName()}")


def bucket_count(spark: SparkSession, n_bytes: int) -> int:
    """Buckets of about 64 MB, no fewer than a shuffle has partitions and, above that, no more than Spark allows by default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_bytes // (64 << 20) + 1, 100_000))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, or name_1, name_2 and so on: the first that no column has, in any case."""
    taken, found, n = {t.lower() for t in taken}, name, 0
    while found.lower() in taken:
        n += 1
        found = f"{name}_{n}"
    return found


def column(name: str) -> Column:
    """A top-level column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def positioned(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed by position, so that their names clash with none of an operator's, and the new names
    of some: a column of just that name counts before one in another case."""
    lower = [c.lower() for c in docs.columns]
    at = [docs.columns.index(n) if n in docs.columns else lower.index(n.lower()) for n in names]
    return docs.toDF(*(f"input_{i}" for i in range(len(lower)))), [f"input_{i}" for i in at]


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with facts by the columns `on`. facts is a written table with one row for each key and, in `n`, how
    many rows have it. Keys with more than a HOT-th of all rows, of which there are at most HOT, are broadcast, so that
    no task gets all rows of a common key; the others are shuffled."""
    total = facts.agg(F.sum(n)).first()[0] or 0
    limit = max(total // HOT, LEAST)
    hot = facts.filter(F.col(n) > limit)
    if hot.isEmpty():
        return rows.join(facts, on, how)
    common = rows.join(F.broadcast(hot), on)
    return common.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.filter(F.col(n) <= limit), on, how))


def python_ready(spark: SparkSession, batch_bytes: int = 16 << 20) -> None:
    """Before Python runs on the executors: sends them this package, once a session, however the driver found it,
    and ends Arrow batches at 16 MB, or so many bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _sent or not package.is_dir():
        return
    archive = f"{tempfile.mkdtemp(prefix='recordloom-')}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    _sent.add(context.applicationId)
