"""Every query with SQL equals it in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.oracle import oracles
from tessera.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"robustness_matrix", "robustness_ranges", "leave_one_provider_out"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(oracles()) - SLOW))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(oracles()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_windows(spark, tmp_path):
    from tessera.streaming.windows import window_hhi, windowed_counts

    source = spark.read.parquet(f"{DATA}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("counts")
    assert got.groupBy().sum("n").first()[0] == source.count()
    assert window_hhi(got).filter("hhi < 0.2 - 1e-9 OR hhi > 1").count() == 0
