import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def same(spark, duck, name, queries, oracle, sf):
    """Rows of a query and of its SQL, as sorted tuples by column name."""
    df = queries[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    res = duck.sql(oracle[name])
    assert sorted(res.columns) == columns
    at = [res.columns.index(c) for c in columns]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert mine == theirs


@pytest.fixture(scope="session")
def agree(spark, duck, sf):
    return lambda name, queries, oracle: same(spark, duck, name, queries, oracle, sf)
