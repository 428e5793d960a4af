"""Every query of the subpackage that has SQL, against DuckDB on the driver's smallest tables."""

import duckdb
import pytest

from gridwarden.llm import queries
from tests.test_catalogue import DATA, rows


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
