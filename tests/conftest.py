import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.path.join(HERE, "llm"), os.environ.get("PYTHONPATH", "")])  # for the workers
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same(duck):
    """Compares a query's rows with those of its SQL."""

    def check(df, sql):
        rel = duck.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        columns = sorted(df.columns)
        at = [rel.columns.index(c) for c in columns]
        want = sorted((tuple(_value(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        got = sorted((tuple(_value(r[c]) for c in columns) for r in df.collect()), key=repr)
        assert got == want

    return check
