"""Every registered query equals its DuckDB oracle on the smallest tables."""
import duckdb
import pytest

from tests.conftest import SF_SMALL
from tollgate.plans.registry import oracle_sql, queries
from tollgate.sources.views import BASE_TABLES
from tools.oracle_check import rows

QS, ORC = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QS))
def test_query_matches_oracle(spark, con, name):
    sdf = QS[name](spark, SF_SMALL).toPandas()
    assert name in ORC, "every registered query has an oracle"
    ddf = con.execute(ORC[name]).df()
    sc, sr = rows(sdf)
    dc, dr = rows(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "drift" in df.columns


def test_coverage_table_names_registered_queries():
    from tools.coverage import COVERAGE
    for key, (_, names, _) in COVERAGE.items():
        for n in names:
            assert n in QS and n in ORC, (key, n)
