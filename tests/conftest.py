import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veinway.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session(cores=4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def values(frame):
    """Rows of a pandas frame in a form that can be compared whatever their order."""
    frame = frame.reindex(sorted(frame.columns), axis=1)

    def plain(x):
        if isinstance(x, float):
            return "null" if x != x else repr(round(x, 6))
        return "null" if x is None else str(x)

    return sorted(tuple(plain(x) for x in row) for row in frame.astype(object).itertuples(index=False))
