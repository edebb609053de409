"""Queries against their SQL at the smallest scale."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from nearfield import queries as core

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = core.queries()[name](spark, DATA).toPandas(), duck.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(core.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['nearfield.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(*e.queries())"
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()
    assert set(found) == set(core.queries())


def test_nothing_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "nearfield")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "nearfield.llm" not in open(os.path.join(folder, f)).read()
