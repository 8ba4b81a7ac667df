"""Every query of the catalogue against its oracle, on the smallest tables; the library without its llm part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tempora.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
    got = order(tuple(r[c] for c in columns) for r in frame.collect())
    cursor = oracle.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == order(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())


def test_imports_without_llm():
    code = "import sys; sys.modules['tempora.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) and 'entry' in dir(e)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
