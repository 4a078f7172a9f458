import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the smallest tables; skips where they are missing."""
    import duckdb

    folder = Path("/root/testdata/sf0.001")
    if not folder.is_dir():
        pytest.skip("test tables are missing")
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL, column names included."""

    def check(query, sql):
        def norm(x):
            return None if x is None or (isinstance(x, float) and x != x) else x

        got = query(spark, "/root/testdata/sf0.001")
        rel = duck.sql(sql)
        names = sorted(rel.columns)
        assert sorted(got.columns) == names
        order = [rel.columns.index(n) for n in names]
        want = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rel.fetchall())
        have = sorted(repr(tuple(norm(r[n]) for n in names)) for r in got.collect())
        assert have == want

    return check
