"""Every query against its SQL twin, and what the driver calls."""

import os

import duckdb
import pytest

from lodestar import registry

SF = os.environ.get("PARITY_SF", "/root/testdata/sf0.001")
TABLES = ("events", "documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    return None if value is None or value != value else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    order = sorted(got.columns)
    have = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    assert have == sorted((tuple(plain(v) for v in r) for r in want[order].astype(object).where(want[order].notna(), None).itertuples(index=False)), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['lodestar.llm'] = None; import __spark_entry__ as e; assert 'rrf_scores' in e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op') for k in e.oracle_sql())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
