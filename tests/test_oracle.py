"""Every registered query against its SQL oracle (DuckDB) on the same tables."""

import pytest

from data_paths import SF_ORACLE
from oracle_harness import compare, duckdb_conn

from campusledger.plans import ORACLE, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    result = compare(spark, name, SF_ORACLE, con)
    if name in ORACLE:
        assert result["ok"], result["problems"]
    else:
        assert result["rows"] >= 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    import importlib.util
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert "latestStatus" in df.columns
