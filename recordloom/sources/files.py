"""CSV and XLSX files as untyped cells with their provenance.

Files are read whole, one task each, by the standard library: headers are kept by position, rows are numbered from the
one after the header on, blank ones counted, and no value is coerced. `large_csv.parse` reads CSV files of any size by
many tasks; for clean ones `read_clean_csv` stays in the JVM.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.shipping import python_ready

#: Default limits: bytes of a file, rows of a table, files of a job.
MAX_BYTES, MAX_ROWS, MAX_FILES = 5 << 20, 5000, 10
#: Characters of a CSV field at most.
FIELD_CHARS = 1 << 30
CELLS = "file string, table_name string, headers array<string>, row_number int, cells array<string>, raw_types array<string>, issue string"
_ARROW = pa.schema([("file", pa.string()), ("table_name", pa.string()), ("headers", pa.list_(pa.string())), ("row_number", pa.int32()), ("cells", pa.list_(pa.string())), ("raw_types", pa.list_(pa.string())), ("issue", pa.string())])


def file_list(spark: SparkSession, paths: Sequence[str], max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """path, length, content, sha256 of the files; raises on other extensions, too large and too many files. Lengths
    are checked before any content is read."""
    if len(paths) > max_files:
        raise ValueError(f"{len(paths)} files; a job takes {max_files}")
    for p in paths:
        if not re.search(r"(?i)\.(csv|xlsx)$", p):
            raise ValueError(f"{p}: only .csv and .xlsx are read")
    df = spark.read.format("binaryFile").load(list(paths))
    if large := df.filter(F.col("length") > max_bytes).select("path").collect():  # at most max_files rows
        raise ValueError(f"larger than {max_bytes} bytes: {[r['path'] for r in large]}")
    return df.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, digests: dict[str, str]) -> DataFrame:
    """files, failing when a content is not the one that was stored. digests: file name -> SHA-256."""
    known = F.create_map(*(F.lit(x) for kv in digests.items() for x in kv)) if digests else F.create_map()
    name = F.element_at(F.split("path", "/"), -1)
    bad = ~F.col("sha256").eqNullSafe(F.try_element_at(known, name))
    return files.withColumn("content", F.when(bad, F.raise_error(F.concat(F.lit("content changed: "), name)).cast("binary")).otherwise(F.col("content")))


def parse(files: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """CELLS for each row of each table. A table with more than max_rows filled rows is refused as a whole: it becomes one
    row with an issue, and so do files that cannot be read."""
    python_ready(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(parse_file(path.rsplit("/", 1)[-1], content, max_rows))
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, CELLS)


def parse_file(name: str, content: bytes, max_rows: int = MAX_ROWS) -> Iterator[dict]:
    try:
        tables = _xlsx(content) if name.lower().endswith(".xlsx") else [(None, _csv(content))]
        for sheet, rows in tables:
            yield from _table(name, sheet or name, rows, max_rows)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, csv.Error) as e:
        yield _row(name, name, [], None, [], [], f"unreadable: {e}")


def _row(file, table, headers, number, cells, kinds, issue=None) -> dict:
    return {"file": file, "table_name": table, "headers": headers, "row_number": number, "cells": cells, "raw_types": kinds, "issue": issue}


def _table(file: str, table: str, rows, max_rows: int) -> Iterator[dict]:
    headers: list[str] | None = None
    out = []
    for number, cells in rows:
        if all(v is None or not v.strip() for v, _ in cells):
            continue
        if headers is None:
            headers, first = [(v or "").strip() or f"column_{i}" for i, (v, _) in enumerate(cells)], number
            continue
        if len(out) == max_rows:
            yield _row(file, table, headers, None, [], [], f"more than {max_rows} rows")
            return
        cells = [*cells[: len(headers)], *[(None, "empty")] * (len(headers) - len(cells))]
        out.append(_row(file, table, headers, number - first, [v if v else None for v, _ in cells], [k if v else "empty" for v, k in cells]))
    yield from out


def _csv(content: bytes):
    """(number of the record in its file, cells). A BOM goes, undecodable bytes are replaced."""
    csv.field_size_limit(FIELD_CHARS)
    reader = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))
    for number, row in enumerate(reader, 1):
        yield number, [(v, "text") for v in row]


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _xlsx(content: bytes):
    """(sheet, rows) of a workbook: shared and inline strings, booleans, dates by number format, formulas as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        root = lambda n: ElementTree.fromstring(z.read(n))
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{{{_NS['m']}}}t"))
        shared = [text(s) for s in root("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        dated = _date_styles(root("xl/styles.xml")) if "xl/styles.xml" in names else set()
        targets = {r.get("Id"): r.get("Target") for r in root("xl/_rels/workbook.xml.rels")}
        for s in root("xl/workbook.xml").iter(f"{{{_NS['m']}}}sheet"):
            target = targets[s.get(_REL)].lstrip("/")
            sheet = root(target if target.startswith("xl/") else f"xl/{target}")
            rows = [(int(r.get("r") or i), _cells(r, shared, dated, text)) for i, r in enumerate(sheet.iter(f"{{{_NS['m']}}}row"), 1)]
            if any(v for _, cells in rows for v, _ in cells):
                yield s.get("name"), rows


def _date_styles(styles) -> set[int]:
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{{{_NS['m']}}}numFmt")}
    is_date = lambda n: 14 <= n <= 22 or bool(re.search(r"[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(n, "")), re.I))
    cells = styles.find("m:cellXfs", _NS)
    return {i for i, x in enumerate(cells if cells is not None else []) if is_date(int(x.get("numFmtId", 0)))}


def _cells(row, shared, dated, text) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, str]] = []
    for c in row.findall("m:c", _NS):
        letters = re.match("[A-Z]*", c.get("r") or "")[0]
        at = 0
        for x in letters:
            at = 26 * at + ord(x) - 64
        out += [(None, "empty")] * ((at or len(out) + 1) - 1 - len(out))
        kind, v, f = c.get("t"), c.find("m:v", _NS), c.find("m:f", _NS)
        raw = v.text if v is not None else None
        if f is not None:
            out.append((f"={f.text or ''}", "formula"))
        elif kind == "s" and raw is not None:
            out.append((shared[int(raw)], "text"))
        elif kind == "inlineStr":
            out.append((text(c), "text"))
        elif kind == "b":
            out.append(("true" if raw == "1" else "false", "bool"))
        elif kind in ("str", "e") or raw is None:
            out.append((raw, "text" if raw else "empty"))
        elif int(c.get("s") or 0) in dated:
            d = datetime(1899, 12, 30) + timedelta(days=float(raw))
            out.append((d.date().isoformat() if d.time() == d.time().min else d.isoformat(), "date"))
        else:
            n = float(raw)
            out.append((str(int(n)) if n.is_integer() else raw, "number"))
    return out


# after reading


def cell_rows(parsed: DataFrame) -> DataFrame:
    """The long form: file, table_id, row_number, col_index, header, value, raw_type; cells out of range do not exist."""
    z = F.posexplode(F.arrays_zip("headers", "cells", "raw_types")).alias("col_index", "x")
    rows = parsed.filter("issue is null").select("file", F.concat_ws("#", "file", "table_name").alias("table_id"), "row_number", z)
    return rows.select("file", "table_id", "row_number", "col_index", F.col("x.headers").alias("header"), F.col("x.cells").alias("value"), F.col("x.raw_types").alias("raw_type"))


def duplicate_headers(parsed: DataFrame) -> DataFrame:
    """file, table_name, header, positions of headers that occur more than once, without regard to case."""
    one = parsed.groupBy("file", "table_name").agg(F.first("headers").alias("h")).select("file", "table_name", F.posexplode("h").alias("at", "header"))
    g = one.groupBy("file", "table_name", F.lower(F.trim("header")).alias("header")).agg(F.array_sort(F.collect_list("at")).alias("positions"))
    return g.filter(F.size("positions") > 1)


def zero_loss_cells(long: DataFrame) -> DataFrame:
    """Cells that are numbers under a header that looks like an identifier: leading zeros may be gone. One warning a cell."""
    return long.filter((F.col("raw_type") == "number") & F.lower("header").rlike(r"\b(id|code|number|no)\b|id$"))


def zero_loss(long: DataFrame) -> DataFrame:
    """zero_loss_cells, counted for each column."""
    return zero_loss_cells(long).groupBy("table_id", "col_index", "header").agg(F.count("*").alias("n"))


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file without repeated headers, all columns as strings, split over tasks by Spark."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"')


def within(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """df, or an error if it has more rows; never a part of it."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return df


def page(df: DataFrame, offset: int, limit: int, order: str = "row_number") -> DataFrame:
    return df.orderBy(order).offset(offset).limit(min(limit, 100))


def around(df: DataFrame, row_number: int, context: int = 2) -> DataFrame:
    return df.filter(F.col("row_number").between(row_number - context, row_number + context)).orderBy("row_number")


def ingest(long: DataFrame, root: str) -> None:
    """Writes cells by file; a file that comes again replaces its former cells and no others."""
    long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(root)


def without_files(df: DataFrame, gone: Sequence[str], column: str = "file") -> DataFrame:
    """df without some files, of which at least one must stay; everything derived is computed anew from it."""
    kept = df.filter(~F.col(column).isin(*gone))
    if kept.isEmpty():
        raise ValueError("a job keeps at least one file")
    return kept


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
