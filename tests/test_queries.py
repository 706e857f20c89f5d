"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestone.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "lineitem", "nation", "orders", "part", "supplier", "events", "documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame, columns):
    return sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_twin(spark, twin, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = twin.sql(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
    spark.catalog.clearCache()
