"""Every query of the engine's own operators against its SQL."""

import numpy as np
import pandas as pd
import pytest

from veldra import registry


def rows(frame, columns):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return round(float(x), 6) + 0.0 if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)

    return sorted((tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, folder, name):
    got = registry.QUERIES[name](spark, folder).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(abs(p - q) <= 2e-5 if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).count() > 0


def test_cross_basis_without_some_vectors(spark, folder, tmp_path):
    """Tokens without a vector take no part, as in the SQL."""
    import duckdb
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    e.withColumn("embedding", F.when(F.col("vec_id") % 25 != 3, F.col("embedding"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["A40_cross_basis"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["A40_cross_basis"]).df()
    assert np.allclose(got[list(want.columns)], want, rtol=0, atol=2e-5)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
