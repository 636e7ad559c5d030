"""Every query with SQL gives the rows of that SQL; every other one runs."""

import pytest
from compare import connection, difference

from netspark.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    found = [tuple(r) for r in df.collect()]
    if name in SQL:
        q = connection(sf).execute(SQL[name])
        assert difference(df.columns, found, [c[0] for c in q.description], q.fetchall()) == ""
    else:
        assert df.columns
