import os
import sys
from pathlib import Path

import pytest

HERE = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path if path.is_file() else f'{path}/*.parquet'}'")
    return con


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return round(float(value), 6)
    return value


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query and its SQL give the same rows, in any order."""

    def check(query, sql):
        mine = query(spark, SF)
        theirs = duck.execute(sql)
        names = [d[0] for d in theirs.description]
        assert sorted(mine.columns) == sorted(names)
        order = sorted(names)
        rows = lambda got, cols: sorted((tuple(normal(dict(zip(cols, r))[c]) for c in order) for r in got), key=repr)  # noqa: E731, B905
        assert rows([tuple(r) for r in mine.collect()], mine.columns) == rows(theirs.fetchall(), names)

    return check
