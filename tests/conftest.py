import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

from pyspark.sql import SparkSession  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with the tables as views."""
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Checks that a query gives the rows of its SQL."""

    def plain(v):
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
        found = duck.sql(sql)
        assert sorted(found.columns) == names
        at = [found.columns.index(c) for c in names]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())

    return check
