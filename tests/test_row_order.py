"""Results that hang on the last bit of a sum, over a table that is read in many parts."""

import pytest
from conftest import SF, values

from veinway.plans.queries import ORACLES, QUERIES

IN_ROW_ORDER = ["a31_issue_levels", "a6_confidence", "a8_flags"]


@pytest.fixture(scope="session")
def parted(tmp_path_factory):
    """The tables, with lineitem's rows out of order and in many row groups."""
    import os

    import duckdb

    folder, con = str(tmp_path_factory.mktemp("parted")), duckdb.connect()
    for f in os.listdir(SF):
        if f != "lineitem.parquet":
            os.symlink(f"{SF}/{f}", f"{folder}/{f}")
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey + n * 100000 AS l_orderkey) FROM '{SF}/lineitem.parquet', range(4) r(n) ORDER BY hash(l_partkey, l_suppkey, l_extendedprice, n)) TO '{folder}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    return folder


@pytest.mark.parametrize("name", IN_ROW_ORDER)
def test_sums_in_row_order_equal_the_sql_on_one_thread(spark, parted, name):
    import os

    import duckdb

    con = duckdb.connect(config={"threads": 1})
    for f in sorted(os.listdir(parted)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{parted}/{f}'")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        ours = QUERIES[name](spark, parted).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert values(ours) == values(con.execute(ORACLES[name]).df())
