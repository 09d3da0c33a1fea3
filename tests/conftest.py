import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame has the columns and rows of a DuckDB query."""

    def value(x):
        return repr(round(x, 6)) if isinstance(x, float) else repr(x.asDict(recursive=True) if hasattr(x, "asDict") else x)

    def check(df, sql, con=duck):
        cols = sorted(df.columns)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(tuple(value(r[i]) for i in at) for r in got.fetchall())
        have = sorted(tuple(value(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        assert have == want

    return check
