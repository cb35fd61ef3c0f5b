import os
import sys
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def same_rows(spark_frame, con, sql):
    """Compares columns by name and rows in any order; floats to nine digits."""
    got, want = spark_frame.toPandas(), con.execute(sql).fetchdf()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert len(got) == len(want)

    def cell(x):
        if pd.isna(x):
            return None
        return round(float(x), 9) if isinstance(x, (int, float, np.number, np.bool_)) else str(x)

    def plain(frame):
        return sorted((tuple(cell(x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)

    assert plain(got) == plain(want)
