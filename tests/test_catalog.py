"""Every registered query that has SQL, against DuckDB on the driver's small tables."""

import os

import numpy as np
import pytest

from lokalis.plans import catalog

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events sales clicks".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in columns if got[c].dtype.kind != "f"] or columns
    got, want = (x[columns].sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-6, atol=2e-3, equal_nan=True), c
        else:
            assert got[c].astype(str).replace("<NA>", "None").tolist() == want[c].astype(str).replace("<NA>", "None").tolist(), c


def test_every_query_has_a_schema(spark, duck):
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 100
