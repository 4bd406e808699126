import os
from pathlib import Path

import duckdb
import pytest

from urlatlas import files
from urlatlas import queries as engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = c.sql(engine.oracle_sql()[name])
    got = engine.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    assert sorted(str([r[x] for x in columns]) for r in got.collect()) == sorted(str([r[k] for k in at]) for r in want.fetchall())


def test_ids_keep_their_ranges(spark):
    """Ranges are sampled: where they are worked out again for the result, ids no longer follow from the sizes counted before."""
    size = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    got = engine.incremental_dictionary(spark, DATA)
    spark.conf.set(size, 1)
    try:
        ids = sorted(r["domain_id"] for r in got.collect())
    finally:
        spark.conf.unset(size)
    assert ids == list(range(len(ids)))


def test_lake_alone(spark):
    """Partitions and files of the lake don't wait for an index of it."""
    engine._lake.cache_clear()
    engine._built.cache_clear()
    stats = {r["dataset_id"]: r["partitions"] for r in engine.storage_stats(spark, DATA).collect()}
    assert sum(stats.values()) == engine.lake_partition_listing(spark, DATA).count() > len(stats)
    assert not files.exists(spark, f"{engine._lake(spark, DATA)}/index")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
