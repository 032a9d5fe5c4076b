"""CSV files of any size, read by many tasks each, with the cells and row numbers that reading a file in one go gives.

Spark deals out the lines of a file in byte ranges. Where a range starts, a quoted field of an earlier range may be open,
so a first pass finds for each range what it makes of either start: whether a quoted field is open at its end, and how
many records end in it. At a line's end these are the only two states, for an unquoted field ends with its line; the
states of all ranges follow by composing these functions in order, and record numbers by adding up counts. The second
pass parses each range by the csv module; what hangs over a range's edge is put together from its lines.

A task holds a record, not a file. Only files without compression can be split, and a lone carriage return ends a
record but not a line, so a file with no other line ends is one task's. Bytes that are no UTF-8 are replaced, a
byte-order mark goes. If a quoted field is still open at the end of a file, its last line end is not kept.
"""

from __future__ import annotations

import csv
import io
import itertools
import operator
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text
from recordloom.shipping import Steps, python_ready, small
from recordloom.sources.files import CELLS, FIELD_CHARS

_SUMMARY = "file string, range long, quoted_after_plain boolean, records_after_plain long, quoted_after_quoted boolean, records_after_quoted long"
_RECORDS = "file string, record long, range long, cells array<string>, text binary"
#: Bytes that are parsed at once, and ranges whose states are sent to all tasks; more are joined by a shuffle.
_BATCH, RANGES = 8 << 20, 1_000_000
BOM = b"\xef\xbb\xbf"


def scan_line(line: bytes, quoted: bool) -> tuple[bool, int, int]:
    """For a line without its end, and whether a quoted field is open before it: whether one is open after it, how many
    records end in it, and where the first of them ends (its own end counts; -1: none does)."""
    at, ends, first = 0, 0, -1
    while True:
        if quoted:
            at = line.find(b'"', at)
            if at < 0:
                return True, ends, first
            if line[at + 1 : at + 2] == b'"':  # a doubled quote
                at += 2
                continue
            at += 1
        quote = line.find(b'"', at)
        # a carriage return ends a record, but the last one of a line is part of the line's end
        end = line.find(b"\r", at, len(line) - 1 if quote < 0 else min(quote, len(line) - 1))
        while end >= 0:
            first, ends = end if first < 0 else first, ends + 1
            end = line.find(b"\r", end + 1, len(line) - 1 if quote < 0 else min(quote, len(line) - 1))
        if quote < 0:
            return False, ends + 1, len(line) if first < 0 else first
        # only a quote at the start of a field opens it; elsewhere it is a character
        quoted = quote == 0 or line[quote - 1] in b",\r"
        at = quote + 1


def parse_records(text: bytes) -> list[list[str]]:
    csv.field_size_limit(FIELD_CHARS)
    return list(csv.reader(io.StringIO(text.decode("utf-8", "replace"), newline="")))


def joined(fragments: Sequence[bytes]) -> list[str]:
    """The cells of a record from its fragments in order."""
    text = b"".join(fragments)
    quoted = False
    for line in text[:-1].split(b"\n"):
        quoted, _, _ = scan_line(line, quoted)
    rows = parse_records(text[:-1] if quoted else text)
    return rows[0] if rows else []


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Rows (file, range, value, then facts of the range) by range: its row without the value, and its lines in order."""

    def rows():
        for b in batches:
            names = [n for n in b.schema.names if n != "value"]
            facts = zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
            yield from zip(facts, b.column(b.schema.get_field_index("value")), strict=True)

    for key, lines in itertools.groupby(rows(), operator.itemgetter(0)):
        first = key[1] == 0
        yield key, (v.as_py().removeprefix(BOM) if first and i == 0 else v.as_py() for i, (_, v) in enumerate(lines))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start), lines in _ranges(batches):
        plain, quoted, n_plain, n_quoted = False, True, 0, 0
        for line in lines:
            plain, n, _ = scan_line(line, plain)
            n_plain += n
            quoted, n, _ = scan_line(line, quoted)
            n_quoted += n
        yield pa.RecordBatch.from_pylist([{"file": file, "range": start, "quoted_after_plain": plain, "records_after_plain": n_plain, "quoted_after_quoted": quoted, "records_after_quoted": n_quoted}], _arrow(_SUMMARY))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie in a range as cells, and what belongs to records over its edges as text."""
    schema = _arrow(_RECORDS)
    for (file, start, quoted, offset), lines in _ranges(batches):
        record, held, size, rows = offset, [], 0, []
        put = lambda cells, text: rows.append({"file": file, "record": record, "range": start, "cells": cells, "text": text})  # noqa: E731, B023
        head = quoted
        for line in lines:
            open_before, (quoted, _, end) = quoted, scan_line(line, quoted)
            if head:
                if end < 0:
                    held.append(line)
                    continue
                put(None, b"".join(x + b"\n" for x in (*held, line[:end])))
                record, held, size, head = record + 1, [], 0, False
                if end == len(line) or end == len(line) - 1 and line.endswith(b"\r") and not quoted:
                    continue
                line = line[end + 1 :]
            held.append(line)
            size += len(line)
            if not quoted and size >= _BATCH:
                for cells in parse_records(b"".join(x + b"\n" for x in held)):
                    put(cells, None)
                    record += 1
                held, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if head and held:
            put(None, b"".join(x + b"\n" for x in held))
        elif held:
            # a record that is open at the end begins after the last one that ended
            whole = parse_records(b"".join(x + b"\n" for x in held))
            if quoted:
                whole.pop()
            for cells in whole:
                put(cells, None)
                record += 1
            if quoted:
                put(None, _tail(held))
        yield pa.RecordBatch.from_pylist(rows, schema)


def _tail(lines: Sequence[bytes]) -> bytes:
    """The text of the record that is open at the end of lines that begin with a record."""
    text, quoted, at = b"".join(x + b"\n" for x in lines), False, 0
    begin = 0
    for line in lines:
        was, (quoted, n, _) = quoted, scan_line(line, quoted)
        if n:
            last = _last_end(line, was)
            begin = at + min(last + 1, len(line) + 1)
        at += len(line) + 1
    return text[begin:]


def _last_end(line: bytes, quoted: bool) -> int:
    """Where the last record that ends in a line does."""
    at, last = 0, -1
    while True:
        after, _, end = scan_line(line[at:], quoted)
        if end < 0:
            return last
        last, at, quoted = at + end, at + end + 1, False
        if at > len(line):
            return last


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _starts(summaries: DataFrame) -> DataFrame:
    """file, range, quoted, offset: whether a quoted field is open where a range starts, and how many records end before
    it. A range either sets the state (both starts lead to one), keeps it, or swaps it; the state at its start is that of
    the last range that set it, swapped as often as ranges since then do. A row for each range."""
    w = Window.partitionBy("file").orderBy("range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("quoted_after_plain") == F.col("quoted_after_quoted")
    swaps = (F.col("quoted_after_plain") & ~F.col("quoted_after_quoted")).cast("int")
    s = summaries.withColumn("swaps", F.sum(swaps).over(w)).withColumn("set", F.when(sets, F.struct(F.col("quoted_after_plain").alias("to"), "swaps")))
    s = s.withColumn("set", F.last("set", ignorenulls=True).over(before)).withColumn("swapped", F.coalesce(F.lag("swaps").over(w), F.lit(0)))
    odd = (F.col("swapped") - F.coalesce("set.swaps", F.lit(0))) % 2 == 1
    s = s.withColumn("quoted", F.coalesce("set.to", F.lit(False)) != odd)
    n = F.when(F.col("quoted"), F.col("records_after_quoted")).otherwise(F.col("records_after_plain"))
    return s.withColumn("n", n).select("file", "range", "quoted", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def records(spark: SparkSession, paths: Sequence[str], steps: Steps | None = None) -> DataFrame:
    """file (its path), record (from 0, blank ones counted), cells of every record of some CSV files."""
    python_ready(spark)
    steps = steps or Steps(spark)
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))
    starts = steps.table(_starts(lines.mapInArrow(_summaries, _SUMMARY)), "starts")
    if starts.limit(RANGES + 1).count() <= RANGES:
        placed = lines.join(F.broadcast(starts), ["file", "range"])  # leaves the lines in their order
    else:
        placed = lines.withColumn("line", F.monotonically_increasing_id()).join(starts, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "line")
    cut = steps.table(placed.select("file", "range", "quoted", "offset", "value").mapInArrow(_records, _RECORDS), "cut")

    def assembled(key: tuple, table: pa.Table) -> pa.Table:
        cells = joined(table.sort_by("range").column("text").to_pylist())
        return pa.table({"file": [key[0].as_py()], "record": [key[1].as_py()], "cells": pa.array([cells], pa.list_(pa.string()))})

    over = cut.filter("text is not null").groupBy("file", "record").applyInArrow(assembled, "file string, record long, cells array<string>")
    return cut.filter("text is null").select("file", "record", "cells").unionByName(over)


def parse(spark: SparkSession, paths: Sequence[str], max_rows: int | None = None, steps: Steps | None = None) -> DataFrame:
    """The rows that `files.parse` gives (CELLS) for CSV files of any size. With max_rows a file with more filled rows is
    refused as a whole."""
    steps = steps or Steps(spark)
    r = steps.table(records(spark, paths, steps).filter(F.exists("cells", lambda x: ~text.is_blank(x))), "records")
    name = lambda h: F.transform(h, lambda x, i: F.coalesce(text.nonblank(x), F.concat(F.lit("column_"), i.cast("string"))))
    heads = r.groupBy("file").agg(F.min("record").alias("_first"), F.count("*").alias("n"), F.min_by("cells", "record").alias("h")).select("file", "_first", "n", name(F.col("h")).alias("headers"))
    heads = steps.table(heads, "heads")
    rows = r.join(small(heads), "file").filter(F.col("record") > F.col("_first"))
    if max_rows is not None:
        rows = rows.filter(F.col("n") - 1 <= max_rows)
    cells = F.transform("headers", lambda _, i: F.when(F.get("cells", i) != "", F.get("cells", i)))
    rows = rows.withColumn("cells", cells)
    base = F.element_at(F.split("file", "/"), -1)
    kinds = F.transform("cells", lambda x: F.when(x.isNull(), "empty").otherwise("text"))
    none = F.array().cast("array<string>")
    out = rows.select(base.alias("file"), base.alias("table_name"), "headers", (F.col("record") - F.col("_first")).cast("int").alias("row_number"), "cells", kinds.alias("raw_types"), F.lit(None).cast("string").alias("issue"))
    if max_rows is not None:
        refused = heads.filter(F.col("n") - 1 > max_rows)
        out = out.unionByName(refused.select(base.alias("file"), base.alias("table_name"), "headers", F.lit(None).cast("int").alias("row_number"), none.alias("cells"), none.alias("raw_types"), F.lit(f"more than {max_rows} rows").alias("issue")))
    return out.select(*(c.split()[0] for c in CELLS.split(", ")))
