"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ravelin.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    text = lambda v: "-" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = all_queries()[name](spark, DATA).toPandas(), duck.execute(all_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql()) - {"model_two_stage", "model_crossfit"}))
def test_other_queries_have_rows(spark, name):
    assert all_queries()[name](spark, DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_features_do_not_read_the_outcome(spark):
    """No window feature changes when departures' block times do."""
    from pyspark.sql import functions as F

    from ravelin.plans import window_queries as wq
    from ravelin.sources import movements as mv

    before = wq.surface_counts(spark, DATA).toPandas()
    load = mv.load
    try:
        mv.load = lambda s, d: load(s, d).withColumn("block_us", F.when(F.col("phase") == "DEP", F.lit(0)).otherwise(F.col("block_us"))).withColumn("taxi_s", F.when(F.col("phase") == "DEP", F.lit(-1.0)).otherwise(F.col("taxi_s")))
        after = wq.surface_counts(spark, DATA).toPandas()
    finally:
        mv.load = load
    assert plain(before) == plain(after)
