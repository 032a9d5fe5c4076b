"""A target service over HTTP, as a source of the records that a change set is compared with and as a sink of operations.

The sink is a data source of its own, `recordloom_target`: each task sends its operations one after the other, under their
operation ids. A service that keeps a ledger of ids answers a repeated one from it, so a task that Spark runs again, a
speculative copy, or a whole write that is made again doubles nothing. What came back for each attempt is written by the
task to a file of its own in the shared folder `attempts`. Files count when the driver has put their names into a commit;
those of failed tasks and aborted writes are never read. Writes to the target itself can't be aborted: they stay, and
the same change set sent again finds them as replays.

Failures of the line, 429 and 5xx are tried again after a growing wait; the rest is final. An address that another
operation of the set gives up may come free only later, as tasks run side by side: `deliver` sends such operations
again for as long as a round brings any of them through.

Null payloads are empty; extra columns are ignored; an empty change set writes nothing. An operation without a key is
refused (`no_key`) and never sent.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from recordloom.operators import delivery
from recordloom.shipping import python_ready

NAME = "recordloom_target"
ATTEMPTS = "operation_id string, key string, attempt_no int, status_code int, code string, revision long, replayed boolean, at double"
#: The paths, names and header of the service.
RECORDS, LOOKUP, RECORD, PATCH = "/employees", "/employees/lookup", "employee", "patch"
KEYS, EMAILS, BY_KEY, BY_EMAIL = "employee_ids", "work_emails", "by_employee_id", "by_work_email"
SCOPE_HEADER = "X-Organization-ID"
#: Records in one lookup.
BATCH = 200
#: Attempts held in a task before they are written out.
FLUSH = 20_000
_ARROW = pa.schema([("operation_id", pa.string()), ("key", pa.string()), ("attempt_no", pa.int32()), ("status_code", pa.int32()), ("code", pa.string()), ("revision", pa.int64()), ("replayed", pa.bool_()), ("at", pa.float64())])


@dataclass(frozen=True)
class Service:
    """Where the target is and how patiently it is asked."""

    url: str
    scope: str | None = None
    timeout: float = 10.0
    tries: int = 4
    base: float = 0.5
    cap: float = 30.0

    def send(self, method: str, path: str, body: dict | None = None) -> tuple[int | None, dict, float | None]:
        """status, answer, seconds that the service wants to be left alone; no status if the line failed."""
        headers = {"Content-Type": "application/json", **({SCOPE_HEADER: self.scope} if self.scope is not None else {})}
        asked = urllib.request.Request(self.url.rstrip("/") + path, None if body is None else json.dumps(body).encode(), headers, method=method)
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout) as r:
                return r.status, _object(r.read()), None
        except urllib.error.HTTPError as e:
            return e.code, _object(e.read()), _seconds(e.headers.get("Retry-After"))
        except (OSError, TimeoutError):
            return None, {}, None

    def patiently(self, method: str, path: str, body: dict | None = None) -> Iterator[tuple[int | None, dict]]:
        """Every attempt's answer; the last one is the outcome."""
        for attempt in range(1, self.tries + 1):
            status, answer, wait = self.send(method, path, body)
            yield status, answer
            if attempt == self.tries or not (status is None or status == 429 or status >= 500):
                return
            time.sleep(delivery.backoff(attempt, self.base, self.cap, wait, random.uniform(0.5, 1.5)))


def _object(body: bytes) -> dict:
    try:
        found = json.loads(body or b"{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _seconds(value: str | None) -> float | None:
    try:
        return max(float(value), 0.0) if value is not None else None
    except ValueError:
        return None


def request(operation: str, key: str, operation_id: str, payload: dict, revision: int | None) -> tuple[str, str, dict | None]:
    """Method, path and body of an operation."""
    at = f"{RECORDS}/{urllib.parse.quote(key, safe='')}"
    if operation == "DELETE":
        asked = {"idempotency_key": operation_id, **({} if revision is None else {"expected_revision": str(revision)})}
        return "DELETE", f"{at}?{urllib.parse.urlencode(asked)}", None
    if operation == "CREATE":
        return "POST", RECORDS, {RECORD: payload, "idempotency_key": operation_id}
    method, name = {"UPDATE": ("PATCH", PATCH), "REPLACE": ("PUT", RECORD)}[operation]
    return method, at, {name: payload, "expected_revision": revision, "idempotency_key": operation_id}


@dataclass
class Written(WriterCommitMessage):
    """The files of a task and how many operations they tell of."""

    files: list[str]
    operations: int


class TargetWriter(DataSourceWriter):
    def __init__(self, service: Service, attempts: str, key: str):
        self.service, self.attempts, self.key = service, attempts, key

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = fs.FileSystem.from_uri(self.attempts)
        store.create_dir(f"{root}/parts", recursive=True)
        files: list[str] = []
        rows: list[dict] = []
        n = 0

        def flush() -> None:
            if rows:
                files.append(f"{uuid.uuid4().hex}.parquet")
                pq.write_table(pa.Table.from_pylist(rows, _ARROW), f"{root}/parts/{files[-1]}", filesystem=store)
                rows.clear()

        for r in iterator:
            n += 1
            rows += self._attempts(r.asDict(recursive=True))
            if len(rows) >= FLUSH:
                flush()
        flush()
        return Written(files, n)

    def _attempts(self, r: dict) -> list[dict]:
        key = r[self.key]
        told = {"operation_id": r["operation_id"], "key": None if key is None else str(key)}
        if key is None:
            return [{**told, "attempt_no": 1, "status_code": 400, "code": "no_key", "revision": None, "replayed": False, "at": time.time()}]
        payload = {**(r.get("payload") or {}), **(r.get("collections") or {})}
        if r["operation"] in ("CREATE", "REPLACE"):
            payload[self.key] = str(key)
        out = []
        for i, (status, answer) in enumerate(self.service.patiently(*request(r["operation"], str(key), r["operation_id"], payload, r["base_revision"])), 1):
            record = answer.get(RECORD) if isinstance(answer.get(RECORD), dict) else {}
            revision = answer.get("revision", answer.get("current_revision", record.get("revision")))
            out.append({**told, "attempt_no": i, "status_code": status, "code": answer.get("code"), "revision": revision, "replayed": bool(answer.get("replayed")), "at": time.time()})
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files of all tasks in one new file: with it they count, and not before."""
        store, root = fs.FileSystem.from_uri(self.attempts)
        store.create_dir(f"{root}/commits", recursive=True)
        said = {"files": [f for m in messages if m for f in m.files], "operations": sum(m.operations for m in messages if m)}
        name = f"{root}/commits/{uuid.uuid4().hex}"
        with store.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps(said).encode())
        store.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.attempts)
        for name in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/parts/{name}")


class TargetSink(DataSource):
    """Options: url, attempts (folder), key, and optionally scope, timeout, tries, base, cap."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> TargetWriter:
        if overwrite:
            raise ValueError("operations are only ever added: use mode append")
        missing = [c for c in (self.options["key"], "operation", "operation_id", "base_revision") if c not in schema.names]
        if missing:
            raise ValueError(f"a change set has columns {missing}, too")
        o = self.options
        service = Service(o["url"], o.get("scope"), *(kind(o.get(n, d)) for n, kind, d in (("timeout", float, 10), ("tries", int, 4), ("base", float, 0.5), ("cap", float, 30))))
        return TargetWriter(service, o["attempts"], o["key"])


def send(changes: DataFrame, service: Service, attempts: str, key: str, tasks: int = 8) -> None:
    """Sends every operation once, from `tasks` tasks at the same time: what the service can take, whatever the cluster's
    size. The order of a task's rows is kept."""
    spark = changes.sparkSession
    python_ready(spark)
    spark.dataSource.register(TargetSink)
    wanted = [c for c in (key, "operation", "operation_id", "payload", "collections", "base_revision") if c in changes.columns]
    o = {"url": service.url, "attempts": attempts, "key": key, "timeout": str(service.timeout), "tries": str(service.tries), "base": str(service.base), "cap": str(service.cap)}
    if service.scope is not None:
        o["scope"] = service.scope
    changes.select(*wanted).repartition(tasks, "operation_id").sortWithinPartitions("operation_id").write.format(NAME).options(**o).mode("append").save()


def attempts_of(spark: SparkSession, attempts: str) -> DataFrame:
    """Every attempt of the committed writes, with error_kind (null: it went through)."""
    store, root = fs.FileSystem.from_uri(attempts)
    commits = store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    files = []
    for c in commits:
        if c.path.endswith(".json"):
            with store.open_input_stream(c.path) as f:
                files += json.loads(f.read())["files"]
    rows = spark.read.schema(ATTEMPTS).parquet(*(f"{attempts}/parts/{f}" for f in files)) if files else spark.createDataFrame([], ATTEMPTS)
    return rows.withColumn("error_kind", delivery.error_kind(F.col("status_code"), F.coalesce("code", F.lit(""))))


def outcomes(spark: SparkSession, attempts: str) -> DataFrame:
    """operation_id, key, status, n_attempts, status_code, code, revision, replayed: by the last attempt of each operation.
    Revision is the one that the service told, of a conflict the target's own."""
    last = F.max_by(F.struct("key", "error_kind", "status_code", "code", "revision", "replayed"), F.struct("at", "attempt_no"))
    o = attempts_of(spark, attempts).groupBy("operation_id").agg(last.alias("l"), F.count("*").alias("n_attempts"))
    status = F.when(F.col("l.error_kind").isNull(), "SUCCEEDED").when(F.col("l.error_kind") == "stale", "STALE_TARGET").when(F.col("l.error_kind") == "retryable", "RETRYABLE").otherwise("FAILED")
    return o.select("operation_id", "l.key", status.alias("status"), "n_attempts", "l.status_code", "l.code", "l.revision", "l.replayed")


def deliver(changes: DataFrame, service: Service, attempts: str, key: str, tasks: int = 8, rounds: int = 100) -> DataFrame:
    """Sends a change set, then again what waits for an address, as long as that brings any of it through. The outcomes."""
    spark = changes.sparkSession
    send(changes, service, attempts, key, tasks)
    for _ in range(rounds):
        done = outcomes(spark, attempts)
        waiting = changes.join(done.filter("code = 'email_in_use'").select("operation_id"), "operation_id", "left_semi")
        before = waiting.count()
        if not before:
            break
        send(waiting, service, attempts, key, tasks)
        if outcomes(spark, attempts).filter("code = 'email_in_use'").join(changes.select("operation_id"), "operation_id", "left_semi").count() == before:
            break
    return outcomes(spark, attempts).join(changes.select("operation_id"), "operation_id", "left_semi")


def lookup(asked: DataFrame, service: Service, key: str, email: str, batch: int = BATCH) -> DataFrame:
    """key, revision, record (JSON) of the target's records that have one of the keys or addresses of a table, asked for in
    batches. A lookup that fails for good fails the task: what the target holds must be known before anything is said."""
    python_ready(asked.sparkSession)
    one = lambda kind, c: asked.select(F.lit(kind).alias("kind"), c.cast("string").alias("value"))
    values = one("key", F.col(key)).union(one("email", F.lower(F.col(email)))).filter("value is not null and value <> ''").distinct()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {"key": [], "email": []}

        def ask(kind: str) -> pa.RecordBatch:
            mine, held[kind] = held[kind][:batch], held[kind][batch:]
            body = {KEYS: mine if kind == "key" else [], EMAILS: mine if kind == "email" else []}
            for status, answer in service.patiently("POST", LOOKUP, body):
                pass
            if status != 200:
                raise RuntimeError(f"lookup failed: status {status}")
            rows = answer.get(BY_KEY if kind == "key" else BY_EMAIL, {}).values()
            return pa.RecordBatch.from_pydict({"key": [str(r[key]) for r in rows], "revision": pa.array([r.get("revision") for r in rows], pa.int64()), "record": [json.dumps(r, sort_keys=True) for r in rows]}, schema=pa.schema([("key", pa.string()), ("revision", pa.int64()), ("record", pa.string())]))

        for b in batches:
            for kind, value in zip(b.column("kind").to_pylist(), b.column("value").to_pylist(), strict=True):
                held[kind].append(value)
                if len(held[kind]) == batch:
                    yield ask(kind)
        for kind in ("key", "email"):
            if held[kind]:
                yield ask(kind)

    return values.mapInArrow(found, "key string, revision long, record string").dropDuplicates(["key"]).withColumnRenamed("key", key)


def records(found: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, revision, fields (strings) of looked-up records, as `diff.outcomes` and `delivery.change_set` take them."""
    return found.select(key, "revision", *(F.get_json_object("record", f"$['{f}']").alias(f) for f in fields if f != key))
