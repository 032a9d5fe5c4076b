"""Sharding by size-tiered compaction, without Python on the executors.

An arrival is appended as a run: a folder of small immutable shards, one Parquet file per write task and at most
`max_rows` rows. Runs whose sizes fall in the same power-of-`fan_in` tier are merged once a tier holds `fan_in` of
them, and a run of small shards is merged by itself, whole files at a time and without a shuffle, into files near the
target size. Runs of SETTLED targets and more stay, so their number is bounded by the data over SETTLED targets, and
that of the others by fan_in for each tier; the driver sees runs, never the names of shards, rows or files.

Every change is published as a numbered manifest, a table with a row for each shard. The table is written aside; then
a small file that names it is put in the version's place by a call that fails if the place is taken: a hard link on a
local or mounted file system, a rename without overwriting elsewhere (atomic on HDFS and on stores with such a rename;
on others only one writer at a time is safe). Of two writers one wins; an append takes the next version then, a merge
is given up. Readers see a manifest's runs only, so a lost executor or a broken run leaves the last version as it was.

Rows are kept as they are: nulls, empty and long texts, ties, repeated rows and extra columns pass through. An empty
table commits a manifest without shards. The column with a row's shard is `_shard`, or the first of `_shard_1`, ...
that the table does not have.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import column, delete, free_name, small

MANIFEST = "shard string, run string, version int, tier int, n_bytes long, n_rows long"
#: A run of so many targets is not merged again.
SETTLED = 64
#: Most shards whose facts are sent to all executors.
BROADCAST_ROWS = 200_000
#: How often an append tries the next version when another writer took one.
TRIES = 20


class Taken(RuntimeError):
    """Another writer committed this version."""


class ShardStore:
    """A folder of runs and manifests. `target` is in bytes of the files."""

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fan_in: int = 4, max_rows: int = 0):
        self.spark, self.root, self.target, self.fan_in, self.max_rows = spark, root, target, fan_in, max_rows
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        return max([int(x[2:]) for x in self._names("manifest") if x.startswith("v-")], default=0)

    def _table(self, version: int) -> str:
        """The name of a version's table."""
        stream = self._fs.open(self._path(f"{self.root}/manifest/v-{version:08d}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards: shard (path under the root), run, version (that added it), tier, n_bytes, n_rows."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{self._table(version)}")

    def commit(self, shards: DataFrame, version: int) -> None:
        """Publishes shards as version; raises Taken if another writer has."""
        name = f"t-{uuid.uuid4().hex}"
        aside, to = f"{self.root}/manifest/_{name}", f"{self.root}/manifest/v-{version:08d}"
        shards.select(*(x.split()[0] for x in MANIFEST.split(", "))).coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        out = self._fs.create(self._path(aside), True)
        out.writeUTF(name)
        out.close()
        try:
            self._place(aside, to)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            delete(self.spark, f"{self.root}/manifest/{name}")
            raise Taken(f"version {version} was committed by another writer") from e
        finally:
            self._fs.delete(self._path(aside), False)

    def _place(self, aside: str, to: str) -> None:
        """Gives a file a name that must be free."""
        if self._fs.getScheme() == "file":
            local = lambda p: self._jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(local(to), local(aside))
            return
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        files.rename(self._path(aside), self._path(to), never)

    # writing

    def _described(self, run: str, version: int, schema) -> DataFrame:
        """Manifest rows of the files of a run. Row counts come from the Parquet footers' row groups."""
        read = self.spark.read.schema(schema).parquet(f"{self.root}/data/{run}")
        rows = read.groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows"))
        name = F.concat(F.lit(f"data/{run}/"), F.element_at(F.split("p", "/"), -1))
        tier = F.floor(F.log(float(self.fan_in), F.greatest(F.col("n_bytes"), F.lit(1)).cast("double")))
        return rows.select(name.alias("shard"), F.lit(run).alias("run"), F.lit(version).alias("version"), tier.cast("int").alias("tier"), "n_bytes", "n_rows")

    def _write(self, rows: DataFrame, max_rows: int = 0) -> str:
        run = uuid.uuid4().hex
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", max_rows).parquet(f"{self.root}/data/{run}")
        return run

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival as a run of small shards; returns the new version."""
        run = self._write(rows, self.max_rows)
        for _ in range(TRIES):
            version = self.version() + 1
            try:
                self.commit(self.manifest(version - 1).unionByName(self._described(run, version, rows.schema)), version)
            except Taken:
                continue
            return version
        raise Taken(f"no version was free {TRIES} times")

    def due(self, least: int | None = None) -> list[list[str]]:
        """The runs to merge with each other."""
        runs = self.manifest().groupBy("run").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        small_files = (F.col("n") > 1) & (F.col("bytes") / F.col("n") < self.target / 2) & (F.col("n") > F.ceil(F.col("bytes") / self.target))
        tier = self._tier(F.col("bytes"))
        # a row for each run that is not settled: some for each tier
        rows = runs.select("run", tier.alias("tier"), small_files.alias("small")).filter(F.col("small") | (F.col("bytes") < SETTLED * self.target)).collect()
        groups: dict[int, list] = {}
        for r in rows:
            groups.setdefault(r["tier"], []).append(r)
        found = []
        for _, members in sorted(groups.items()):
            if len(members) >= max(2, least or self.fan_in):
                found.append(sorted(r["run"] for r in members))
            else:
                found += [[r["run"]] for r in members if r["small"]]
        return found

    def merge(self, schema, least: int | None = None) -> int:
        """Merges every tier that holds `least` (fan_in) runs or more, and runs of small shards; returns the version.

        Files are read and laid together by coalesce, so no row is shuffled."""
        current, due = self.version(), self.due(least)
        if not due:
            return current
        version, gone = current + 1, [run for runs in due for run in runs]
        live = self.manifest(current)
        shards = live.filter(~F.col("run").isin(gone))
        for runs in due:
            size = live.filter(F.col("run").isin(runs)).agg(F.sum("n_bytes")).first()[0]
            read = self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{run}" for run in runs))
            shards = shards.unionByName(self._described(self._write(read.coalesce(max(1, round(size / self.target)))), version, schema))
        self.commit(shards, version)
        return version

    def compact(self, schema) -> int:
        """Merges until no tier is due."""
        before, version = -1, self.version()
        while version != before:
            before, version = version, self.merge(schema)
        return version

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the runs and manifests that only versions before the last `keep` refer to, and what broken runs left.
        No other writer may be at work."""
        latest = self.version()
        kept = range(max(1, latest - keep + 1), latest + 1)
        runs = {r["run"] for v in kept for r in self.manifest(v).select("run").distinct().collect()}
        for name in self._names("data"):
            if name not in runs:
                self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
        wanted = {f"v-{v:08d}" for v in kept} | {self._table(v) for v in kept}
        for name in self._names("manifest"):
            if name not in wanted:
                self._fs.delete(self._path(f"{self.root}/manifest/{name}"), True)

    def drop(self) -> None:
        """Deletes the store."""
        delete(self.spark, self.root)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, with the shard that each is in as `_shard`."""
        runs = sorted(r["run"] for r in self.manifest(version).select("run").distinct().collect())
        name = free_name("_shard", schema.names)
        if not runs:
            return self.spark.createDataFrame([], schema).withColumn(name, F.lit(None).cast("string"))
        read = self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{run}" for run in runs))
        path = F.split(F.col("_metadata.file_path"), "/")
        return read.select(*map(column, schema.names), F.concat_ws("/", F.lit("data"), F.element_at(path, -2), F.element_at(path, -1)).alias(name))

    def audit(self, schema, version: int | None = None) -> DataFrame:
        """shard, counted, fits, open of each shard in the manifest: whether the rows that it holds are as many as the manifest
        says; whether its size keeps the rule for merged files, which is two targets at most and, but for one shard of
        a run, half a target at least; and whether its run's tier holds fewer than fan_in runs."""
        read = self.read(schema, version)
        shard = read.columns[-1]
        held = read.groupBy(F.col(shard).alias("s")).agg(F.count("*").alias("held"))
        live = self.manifest(version)
        runs = live.groupBy("run").agg(F.count_if(F.col("n_bytes") < self.target / 2).alias("small"), self._tier(F.sum("n_bytes")).alias("run_tier"))
        runs = runs.join(runs.groupBy("run_tier").agg(F.count("*").alias("in_tier")), "run_tier")  # a row for each run that is not settled, and few more
        live = live.join(runs, "run").join(held, F.col("shard") == F.col("s"), "left")
        fits = (F.col("n_bytes") <= 2 * self.target) & ((F.col("n_bytes") >= self.target / 2) | (F.col("small") <= 1))
        settled = self._tier(F.lit(SETTLED * self.target))
        return live.select("shard", (F.coalesce("held", F.lit(0)) == F.col("n_rows")).alias("counted"), fits.alias("fits"), ((F.col("in_tier") < self.fan_in) | (F.col("run_tier") >= settled)).alias("open"))

    def _tier(self, n_bytes: Column) -> Column:
        """The power of fan_in that a run's size is at."""
        return F.floor(F.log(float(self.fan_in), F.greatest(n_bytes, F.lit(1)).cast("double")))


def compacted(rows: DataFrame, root: str, target: int = 128 << 20, fan_in: int = 4, max_rows: int = 8192, arrivals: Sequence[Column] = ()) -> tuple[ShardStore, DataFrame]:
    """Appends rows as one arrival, or as one for each of some conditions of which every row meets one; compacts, removes
    what was merged away, and reads the last version."""
    store = ShardStore(rows.sparkSession, root, target, fan_in, max_rows)
    for arrival in arrivals or [F.lit(True)]:
        store.append(rows.filter(arrival))
    store.compact(rows.schema)
    store.vacuum()
    return store, store.read(rows.schema)


def stored(rows: DataFrame, root: str, **options) -> DataFrame:
    """The rows as compacted reads them, with `counted`, `fits` and `open` of their shard (named apart from the rows'
    columns)."""
    store, read = compacted(rows, root, **options)
    facts = small(store.audit(rows.schema), BROADCAST_ROWS)
    shard, names = read.columns[-1], ("counted", "fits", "open")
    facts = facts.select(F.col("shard").alias("shard of facts"), *(F.col(x).alias(free_name(x, read.columns)) for x in names))
    return read.join(facts, column(shard) == F.col("`shard of facts`"), "left").drop("shard of facts")
