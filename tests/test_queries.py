import pytest
from conftest import SF, values

import veinway.plans.more  # noqa: F401
import veinway.plans.single  # noqa: F401
from veinway.plans.queries import ORACLES, QUERIES

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert values(ours) == values(theirs)


#: The smallest tables accept no link; what the query gives is checked in test_relations.
ROWS_AT = {"t5_bridges": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, ROWS_AT.get(name, SF)).limit(1).count() == 1


def test_entry(spark, duck):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    want = duck.execute(entry.oracle_sql()["n1_network_intelligence"]).df().iloc[0]
    assert row.asDict() == want.to_dict() and row["components"] > 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
