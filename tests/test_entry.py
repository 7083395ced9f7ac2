"""The driver contract: names, oracles and the flagship query, with and without the training-data subpackage."""

import importlib
import importlib.util
import os
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

from tesserae.plans import registry  # noqa: E402


def test_names():
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys() and registry.queries().keys() <= entry.queries().keys()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "title", "score"}


def test_the_rest_needs_no_subpackage(monkeypatch):
    import __spark_entry__ as entry

    found = importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name, *a: None if name == "tesserae.llm" else found(name, *a))
    assert entry.queries().keys() == registry.queries().keys()


def test_queries_are_named_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def same(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(same(r[c]) for c in columns) for r in df.collect())
    answer = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(same(r[i]) for i in at) for r in answer.fetchall())
