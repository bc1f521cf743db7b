import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def _same_rows(frame, con, sql):
    names = sorted(frame.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    cur = con.execute(sql)
    have = [x[0] for x in cur.description]
    assert sorted(have) == names
    b = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    assert a == b


@pytest.fixture(scope="session")
def same_rows():
    """Holds the rows of a query against those of its SQL."""
    return _same_rows
