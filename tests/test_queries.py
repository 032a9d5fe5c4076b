"""Every query of the record engine against its DuckDB equivalent, and the entry points."""

import subprocess
import sys
from pathlib import Path

import pytest

from recordloom.plans import catalog
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF) == []


def test_header_tokens(spark):
    rows = {r["header"]: r for r in catalog.queries()["header_tokens"](spark, SF).collect()}
    assert rows["IDValue"]["tokens"] == ["id", "value"] and rows["T-Shirt Size"]["slug"] == "tshirt_size"


def test_queries_without_the_corpus_operators():
    code = "import sys; sys.modules['recordloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'profile_customer' in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
