import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{folder}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = con.sql(sql)
    return sorted(r.columns), [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]


def plain(v):
    if v is None or v != v:
        return None
    return v if isinstance(v, bool) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)


def same(df, sql, folder):
    columns, expected = duck(sql, folder)
    assert sorted(df.columns) == columns
    key = lambda rows: sorted(([plain(r[c]) for c in columns] for r in rows), key=str)
    assert key([r.asDict() for r in df.collect()]) == key(expected)
