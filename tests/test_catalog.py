"""Every catalog query against its SQL in DuckDB."""

import duckdb
import pytest
from pathlib import Path

from fathomgrid.plans import catalog, code_queries, service_queries  # noqa: F401


def rows(df):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def nothing(sf, tmp_path_factory):
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("nothing")
    for p in Path(sf).glob("*.parquet"):
        pq.write_table(pq.read_schema(p).empty_table(), folder / p.name)
    return str(folder)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_empty_tables_do_no_harm(spark, nothing, name):
    assert catalog.QUERIES[name](spark, nothing).count() <= 20
