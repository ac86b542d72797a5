"""Every query with SQL gives DuckDB's rows; the others run."""

import pytest

from episodica.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(name, against):
    against(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
