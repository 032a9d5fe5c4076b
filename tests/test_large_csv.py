"""CSV files read in byte ranges give what reading them in one go gives."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.sources import files, large_csv


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "151")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@settings(deadline=None, max_examples=500)
@given(st.lists(st.text(alphabet='",\ra b', max_size=12), max_size=8))
def test_scanned_lines_are_the_records_of_the_csv_module(lines):
    """Also where quotes stand inside of fields, or carriage returns alone."""
    quoted, n = False, 0
    for line in lines:
        quoted, ends, first = large_csv.scan_line(line.encode(), quoted)
        assert (first < 0) == (ends == 0)
        n += ends
    text = "".join(x + "\n" for x in lines)
    assert n + quoted == len(list(csv.reader(io.StringIO(text, newline=""))))


def made(rng, n):
    """Lines with quoted line ends and commas, doubled and stray quotes, blanks and bytes that are no text."""
    say = lambda: "".join(rng.choice('ab ,"\n\ré') for _ in range(rng.randint(0, 9)))
    out = bytearray(rng.choice([b"", large_csv.BOM]) + b"\n" * rng.randrange(3) + b' ID ,Name,,"x\ny"\n')
    for _ in range(n):
        cells = []
        for _ in range(rng.randint(0, 5)):
            s, how = say(), rng.random()
            cells.append('"' + s.replace('"', '""') + '"' if how < 0.6 else s.replace('"', "").replace("\n", "").replace("\r", "").replace(",", "") + rng.choice(["", "", 'q"', 'q"x"']))
        out += ",".join(cells).encode() + rng.choice([b"\n", b"\n", b"\r\n", b"\r", b"\xff\n"])
    if rng.random() < 0.5:
        out += b'last,"' + b"long\n" * rng.randrange(40) + b'end"'
    return bytes(out)


def rows(df):
    return sorted((r["file"], r["row_number"], tuple(r["headers"]), tuple(r["cells"]), tuple(r["raw_types"])) for r in df.filter("issue is null").collect())


@pytest.mark.parametrize("ranges", [large_csv.RANGES, 3])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, small_ranges, monkeypatch, ranges):
    monkeypatch.setattr(large_csv, "RANGES", ranges)
    monkeypatch.setattr(large_csv, "_BATCH", 40)
    rng, want = random.Random(ranges), []
    for k in range(7):
        content = made(rng, rng.randint(0, 40))
        (tmp_path / f"f{k}.csv").write_bytes(content)
        want += [(r["file"], r["row_number"], tuple(r["headers"]), tuple(r["cells"]), tuple(r["raw_types"])) for r in files.parse_file(f"f{k}.csv", content, 10_000)]
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_bytes(b"a,b\n")
    got = rows(large_csv.parse(spark, [str(tmp_path)]))
    assert got == sorted(want) and len(got) > 60


def test_one_record_over_many_ranges_and_a_limit(spark, tmp_path, small_ranges):
    text = 'id,note\n1,"' + "a line, of many\n" * 200 + '"\n2,x\n\n3,"open\n'
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("id\n" + "\n".join(map(str, range(50))))
    found = large_csv.parse(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], max_rows=49).collect()
    a = {r["row_number"]: r["cells"] for r in found if r["file"] == "a.csv"}
    assert a == {1: ["1", "a line, of many\n" * 200], 2: ["2", "x"], 4: ["3", "open"]}
    assert [(r["issue"], r["cells"]) for r in found if r["file"] == "b.csv"] == [("more than 49 rows", [])]
    assert large_csv.parse(spark, [str(tmp_path / "b.csv")], max_rows=50).count() == 50


def test_files_of_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "b.csv").write_bytes(b"\n \n,,\n")
    assert large_csv.parse(spark, [str(tmp_path)]).collect() == []
