import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TZ", "UTC")
DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip(f"{DATA} is not there")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """A value that compares alike from either engine."""
    import pandas as pd

    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    return round(float(value), 4) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def same_rows(left, right):
    """Two pandas frames hold the same rows, in any order."""
    assert sorted(left.columns) == sorted(right.columns)
    names = sorted(left.columns)
    rows = [sorted(([plain(v) for v in row] for row in frame[names].itertuples(index=False)), key=str) for frame in (left, right)]
    assert len(rows[0]) == len(rows[1])
    for a, b in zip(*rows, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 * max(1, abs(x)), (a, b)
