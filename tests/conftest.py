import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def against(spark):
    """Compares a query with its SQL in DuckDB, as sets of rows with repeats."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")

    def plain(v):
        import decimal

        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    def run(query, sql):
        df = query(spark, folder)
        got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
        found = con.sql(sql)
        at = [found.columns.index(c) for c in sorted(df.columns)]
        assert sorted(found.columns) == sorted(df.columns)
        want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
        assert got == want

    return run
