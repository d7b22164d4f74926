import datetime
import math

import pytest

import __spark_entry__ as entry
from terrainframe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 9)
        return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, sf_dir):
    from terrainframe.streaming.monitor import run_quality

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    q = run_quality(stream).writeStream.outputMode("complete").format("memory").queryName("runs").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert key(spark.table("runs")) == key(run_quality(events))
