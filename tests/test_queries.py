"""Every registered query runs at the smallest size; those with SQL agree with DuckDB."""

import math

import duckdb
import pytest

from vaksetu.plans import corpus_queries, queries  # noqa: F401

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def key(row):
    return tuple("~" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(key(r) for r in df.select(*cols).collect())
    assert rows
    if name in queries.ORACLES:
        rel = duck.sql(queries.ORACLES[name])
        assert sorted(rel.columns) == cols
        assert rows == sorted(key(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_streamed_clips(spark, tmp_path):
    from vaksetu.streaming.reports import streaming_clips

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.1, 4.0), (1, 8.0, 33.0), (1, None, None)], "recording long, start_s double, end_s double")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = streaming_clips(rows).writeStream.format("memory").queryName("clips_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start_s, r.end_s) for r in spark.table("clips_out").collect()) == [(0.0, 4.0), (8.0, 18.0), (18.0, 28.0), (28.0, 33.0)]
