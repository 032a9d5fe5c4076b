"""Records that are kept up to date are those that a whole job gives."""

import random

import pytest

from recordloom.plans import contract as contracts
from recordloom.plans import incremental, job
from recordloom.sources import files
from recordloom.sources.versioned import Store
from recordloom.streaming.ingest import arriving_records

DAY = "2024-12-31"
FILES = {
    "a.csv": "Employee ID,Full Name,Work Email,Hire Date\n1,Ann,a@x.com,2020-01-02\n2,Bob,b@x.com,2020-01-03\n3,Cid,c@x.com,2020-01-04\n",
    "b.csv": "Employee ID,Full Name,Work Email,Hire Date\n4,Dan,B@x.com,2021-01-02\n5,Eve,e@x.com,2021-01-03\n",
    "c.csv": "Employee ID,Full Name\n1,Anna\n5,Eve\n",
    "01_vehicles.csv": "Employee ID,Vehicle Type,Registration Number\n3,car,R1\n5,car,R2\n9,car,R3\n",
}


def cells_of(spark, tmp_path, texts):
    paths = []
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        paths.append(str(tmp_path / name))
    return files.cell_rows(files.parse(files.file_list(spark, paths))).drop("raw_type")


def shown(out):
    records = {r["entity_key"]: r["record_hash"] for r in out["snapshots"].collect()}
    return records, {(r["entity_key"], r["path"], r["issue"]) for r in out["issues"].filter("entity_key is not null").collect()}


def current(store):
    now = store.latest()
    records = {r["entity_key"]: r["record_hash"] for r in incremental.states(now).filter("record_hash is not null").collect()}
    return records, {tuple(r) for r in incremental.issues(now).collect()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """What a job gives for some of the files."""
    c, known = contracts.load(), {}

    def run(*names):
        key = tuple(sorted(names))
        if key not in known:
            cells = cells_of(spark, tmp_path_factory.mktemp("whole"), {n: FILES[n] for n in key})
            known[key] = shown(job.run(cells.drop("file"), c, DAY))
        return known[key]

    return run


def test_files_that_come_and_go(spark, tmp_path, whole):
    c, store = contracts.load(), Store(spark, f"file://{tmp_path}/store")
    update = lambda *names, removed=(): incremental.update(store, c, DAY, cells_of(spark, tmp_path, {n: FILES[n] for n in names}) if names else None, removed)
    update("a.csv")
    assert len(current(store)[0]) == 3
    update("b.csv", "01_vehicles.csv")
    # 2 shares its address with 4 now, and 3 has a vehicle; 1 is not looked at again
    assert current(store) == whole("a.csv", "b.csv", "01_vehicles.csv")
    at = {r["entity_key"]: r["at"] for r in incremental.states(store.latest()).collect()}
    assert at == {"1": 1, "2": 2, "3": 2, "4": 2, "5": 2}
    assert {r["entity_key"]: r["change"] for r in store.latest().read("history").filter("at = 2").collect()} == {"2": "removed", "3": "changed", "5": "added"}
    assert [r["row_number"] for r in incremental.orphans(store.latest()).collect()] == [3]
    update("c.csv")
    assert current(store) == whole(*FILES)
    # the same file again: a version, but no change
    update("c.csv")
    assert store.latest().read("history").filter("at = 4").count() == 0 and current(store) == whole(*FILES)
    update(removed=["b.csv"])
    assert current(store) == whole("a.csv", "c.csv", "01_vehicles.csv")
    assert store.latest().read("history").filter("at = 5").count() > 0
    gone = store.latest()
    incremental.compact(store)
    assert current(store) == whole("a.csv", "c.csv", "01_vehicles.csv") and store.latest().read("state").count() < gone.read("state").count()
    with pytest.raises(ValueError, match="at least one"):
        update(removed=["a.csv", "c.csv", "01_vehicles.csv"])
    assert store.latest().version == gone.version + 1


def test_arriving_files_in_any_order(spark, tmp_path, whole):
    c, inbox = contracts.load(), tmp_path / "in"
    inbox.mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda: arriving_records(spark, str(inbox), str(tmp_path / "cp"), store, c, DAY).awaitTermination(240)
    names = random.Random(4).sample(sorted(FILES), len(FILES))
    for part in (names[:2], names[2:]):
        for name in part:
            (inbox / name).write_text(FILES[name])
        run()
    assert current(store) == whole(*FILES)
    assert store.latest().version == 2
