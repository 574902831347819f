"""Results that hang on the last bit of a sum, over a table that lies in many files."""

import os

import pytest
from conftest import values

from veinway.plans.queries import ORACLES, QUERIES

SOURCE = "/root/testdata/sf0.01"
BY_FILES = ["a31_issue_levels", "a6_confidence", "a8_flags"]


@pytest.fixture(scope="session")
def filed(tmp_path_factory):
    """The tables, with the rows of each order of lineitem in several files."""
    import duckdb

    folder, con = str(tmp_path_factory.mktemp("filed")), duckdb.connect()
    for f in os.listdir(SOURCE):
        if f != "lineitem.parquet":
            os.symlink(f"{SOURCE}/{f}", f"{folder}/{f}")
    os.makedirs(f"{folder}/lineitem.parquet")
    for k in range(7):
        name = f"part {k}.parquet"
        con.execute(f"COPY (SELECT * FROM '{SOURCE}/lineitem.parquet' WHERE hash(l_partkey, l_suppkey, l_extendedprice) % 7 = {k}) TO '{folder}/lineitem.parquet/{name}' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", BY_FILES)
def test_sums_go_through_files_in_the_order_of_their_paths(spark, filed, name):
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    for f in sorted(os.listdir(filed)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{filed}/{f}{'/**/*.parquet' if os.path.isdir(f'{filed}/{f}') else ''}'")
    assert values(QUERIES[name](spark, filed).toPandas()) == values(con.execute(ORACLES[name]).df())
